"""Prefix trie, spelling variants and packing against plain code: edge rows, many shards, hot groups."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import chunk_tokens, pack_plan, packing, prefix_trie, queries, spelling
from kinweave.llm.shared import crc_text

from .common import edge_docs

# Conversation trie

CONV = "conv_id long, turn long, role string, text string, ids string, shard int, id int, n int"


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        built[c] = (convs.get(base, [])[:h] if h else []) + ts[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += own
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n], sha(ends[n])) for n, m in members.items()
    )


def trie(spark, rows):
    convs = prefix_trie.conversations(spark.createDataFrame(rows, CONV).repartition(4))
    c = F.col("conv_id")
    found = prefix_trie.prefix_trie(prefix_trie.rebuilt(convs, c - c % 5, (crc_text(c) % 9).cast("int"), 8))
    return sorted(tuple(-1 if v is None else v for v in r) for r in found.collect())


def random_turns(seed, n, deep=12):
    r = random.Random(seed)
    rows = []
    for c in range(-7, n):
        for t in range(r.choice([1, 1, 2, 3, 5, deep])):
            rows.append((c, r.choice([t, t, t, 1, None]), r.choice(["user", "bot", None]), r.choice(["a", "bé", "", None, "long text\n"]), "x", 1, 2, 3))
    return [*rows, *rows[:5], (None, 0, "user", "lost", "x", 1, 2, 3)]


@pytest.mark.parametrize("shard_turns", [20, 100_000])
def test_trie(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard_turns)
    rows = random_turns(3, 120)
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_one_hot_conversation(spark, monkeypatch):
    """Copies of one conversation, and many that go on below one path: turns looked up by broadcast, blocks of ids."""
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 500)
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", 7)
    monkeypatch.setattr(prefix_trie, "HOT_ROWS", 50)
    rows = [(c, t, "u", f"turn {t}", "x", 1, 2, 3) for c in range(150) for t in range(4)]
    rows += [(c, t, "u", f"turn {t}" if t < 30 + c % 7 else f"own {c}", "x", 1, 2, 3) for c in range(1000, 1040) for t in range(60)]
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_without_conversations(spark):
    assert trie(spark, []) == []
    rows = [(3, None, None, None, "x", 1, 2, 3)]
    assert trie(spark, rows) == plain_trie(rows)


def test_tree_is_balanced():
    tree = prefix_trie.TernaryTree()
    for i in prefix_trie.medians(1023):
        tree.insert([i], [1], 1, i)
    waiting, most = [(tree.down[0], 1)], 0
    while waiting:
        at, d = waiting.pop()
        most = max(most, d)
        waiting += [(b, d + 1) for b in (tree.low[at], tree.high[at]) if b]
    assert most == 10 and sorted(prefix_trie.medians(9)) == list(range(9))


# Spelling


def plain_spelling(rows, drop_every=31, shortest=7, least=2, ratio=10):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if abs(len(a) - len(b)) != 1:
            return False
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, count = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def spelled(docs, **kw):
    found = spelling.spelling_forms(docs, **kw)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("part", [100, 1 << 20])
def test_spelling(spark, monkeypatch, part):
    monkeypatch.setattr(spelling, "PART_CHARS", part)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    r = random.Random(part)
    stems = ["aabbaab", "bbaabba", "ababababab", "Écolière", "straße÷×ÿ", "aaaaaaaa", "bookkeeper"]
    words = [*stems]
    for _ in range(150):  # neighbours of neighbours, over few letters
        w = r.choice(words)
        i, c = r.randrange(len(w) + 1), r.choice("abé")
        words.append(r.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]]))
    texts = [" ".join(r.choices(words, k=30) + [stems[0]] * 40 + [stems[3].upper()] * 3) for _ in range(40)]
    docs = edge_docs(spark, [*texts, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + " " + "x" * 2999, "日本" + stems[0] + "ł" + stems[0]])
    plain = [(row["doc_id"], row["text"]) for row in docs.collect()]
    monkeypatch.setattr(spelling, "SHARD_WORDS", 7)
    assert spelled(docs) == plain_spelling(plain)
    assert spelled(docs, drop_every=3, shortest=1, least=1, ratio=2) == plain_spelling(plain, 3, 1, 1, 2)


def test_spelling_chains_and_empty(spark):
    """Forms that lead on: the root is the end of the chain."""
    counts = {"abcdefgh": 2, "abcdefgx": 20, "abcdefyx": 200, "abcdezyx": 2000}
    docs = spark.createDataFrame([(i, " ".join([w] * k)) for i, (w, k) in enumerate(counts.items())], "doc_id long, text string")
    found = {r[0]: r[1:3] for r in spelled(docs, drop_every=1 << 40)}
    assert found == {"abcdefgh": ("abcdefgx", "abcdezyx"), "abcdefgx": ("abcdefyx", "abcdezyx"), "abcdefyx": ("abcdezyx", "abcdezyx"), "abcdezyx": (None, "abcdezyx")}
    assert spelled(edge_docs(spark).limit(0)) == []


# Packing


def check_packing(found, lengths_by_row, capacity):
    """Gapless sequences, and every row's pieces whole and cut only where they must be."""
    rows = found.collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    pieces = Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows)
    want = Counter()
    for key, n in lengths_by_row:
        for piece in range(-(-n // capacity)):
            want[key, piece, piece * capacity, min(capacity, n - piece * capacity)] += 1
    assert pieces == want
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(spark, capacity):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    docs = edge_docs(spark, ["same text, hot."] * 300)
    ids = [(r["doc_id"], [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]
    found = packing.pack(docs, queries.vocabulary_path(), capacity, with_ids=True).cache()
    n = check_packing(found, [(k, len(x)) for k, x in ids], capacity)
    total = sum(len(x) for _, x in ids)
    assert n <= 1.25 * total / capacity + 1
    texts = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: r["start"]):
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        if r["doc_id"] is not None:
            texts[r["doc_id"]].append(bytes(r["ids"]))
    assert {k: b"".join(v) for k, v in texts.items()} == {k: np.array(x, "<u4").tobytes() for k, x in ids if k is not None}
    assert packing.pack(docs.limit(0), queries.vocabulary_path(), capacity).count() == 0


def test_registered_packing(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    want, lengths = set(), []
    for r in queries.table(spark, sf, "documents").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        lengths.append((r["doc_id"], len(ids)))
        want |= {(r["doc_id"], a // 4096, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for a in range(0, len(ids), 4096)}
    found = queries.op13_packing(spark, sf).cache()
    assert {tuple(r)[:5] for r in found.collect()} == want
    assert check_packing(found, lengths, 4096) <= -(-sum(n for _, n in lengths) // 4096) + 1


def test_plan_of_many_lengths():
    r = np.random.RandomState(5)
    for lengths in (r.randint(1, 4097, 3000), r.randint(600, 1800, 2000), np.ones(50_000, int), np.full(7, 4096), r.choice([1366, 2731, 700], 999)):
        h = Counter(lengths.tolist())
        plan = pack_plan.pack_plan(h, 4096)
        got = Counter()
        for uses, config in plan.configurations:
            assert sum(k * n for k, n in config) <= 4096
            for k, n in config:
                got[k] += uses * n
        assert got == h
        assert lengths.sum() / 4096 <= plan.bound + 1e-6 and plan.bound <= plan.sequences <= 1.1 * plan.bound + 1
    assert pack_plan.pack_plan({}, 4096).sequences == 0


def test_knapsack():
    r = np.random.RandomState(2)
    for _ in range(20):
        worth = np.where(r.rand(31) < 0.4, r.rand(31), -1e30)
        worth[0] = -1e30
        plain = [0.0] * 31
        for room in range(1, 31):
            plain[room] = max([plain[room - 1], *(plain[room - k] + worth[k] for k in range(1, room + 1))])
        assert np.allclose(pack_plan.knapsack(worth)[0], plain)


def test_tokens_of_odd_texts(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    r = random.Random(3)
    odd = ["a", "B", "é", "É", "İ", "Σ", "ß", "ﬁ", " ", "\x1c", "\x1e", " ", "\x85", "\xa0", "'s", "'T", "12", "½", "²", "!", "?!", ". ", ", ", "_", ".\n"]
    odd += ["<|endoftext|>", "<|ENDOFTEXT|>", "日本", "é", "́", "한", "가", "😀", "ª", "\n", "x" * 30, "᠎", "​", "ǅ", "ŉ"]
    texts = ["".join(r.choice(odd) for _ in range(r.randrange(1, 25))) for _ in range(1500)]
    texts += [" ".join(texts), "word" * 400, None, ""]
    want = [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    for cache, part in ((400_000, 1 << 20), (50, 200)):
        monkeypatch.setattr(chunk_tokens, "CACHE_PIECES", cache)
        monkeypatch.setattr(chunk_tokens, "PART_CHARS", part)
        encoder = chunk_tokens.ChunkEncoder(chunk_tokens.vocabulary(queries.vocabulary_path()))
        assert encoder.encode(texts) == want
        assert [encoder.encode([x])[0] for x in texts[-200:]] == want[-200:]
