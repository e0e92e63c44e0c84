"""Text sources as DataFrames: pileups, targets, panels, genomes, recombination maps, VCFs and pedigrees."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import IUPAC, KNOWN, X, chrom_id, decode_gt, info_map, phred, sex

#: GRCh37 lengths of the autosomes and X.
GRCH37 = {
    1: 249250621, 2: 243199373, 3: 198022430, 4: 191154276, 5: 180915260, 6: 171115067, 7: 159138663, 8: 146364022,
    9: 141213431, 10: 135534747, 11: 135006516, 12: 133851895, 13: 115169878, 14: 107349540, 15: 102531392,
    16: 90354753, 17: 81195210, 18: 78077248, 19: 59128983, 20: 63025520, 21: 48129895, 22: 51304566, X: 155270560,
}


def _fail(message: str, what: Column, kind: str = "string") -> Column:
    return F.raise_error(F.concat(F.lit(message), F.coalesce(what, F.lit("null")))).cast(kind)


# Pileups


def parse_pileup(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """(chrom, pos, ref, samples) of tab-separated pileup lines: three columns a sample. Works on streams as well."""
    f = F.split(F.col(line_col), "\t")
    ref = F.upper(f[2])
    ref = F.when(ref.isin(*KNOWN, "N", "*"), ref).when(ref.isin(*IUPAC), F.lit("N")).otherwise(_fail("not an allele: ", ref))
    samples = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(f) - 3) / 3).cast("int") - 1),
        lambda i: F.struct(
            i.alias("sample"), F.get(f, 3 + 3 * i).cast("int").alias("depth"), F.get(f, 4 + 3 * i).alias("bases"), F.get(f, 5 + 3 * i).alias("quals")
        ),
    )
    return lines.filter(F.col(line_col) != "").select(chrom_id(f[0]).alias("chrom"), f[1].cast("long").alias("pos"), ref.alias("ref"), samples.alias("samples"))


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    return parse_pileup(spark.read.text(path))


def read_symbols(bases: Column) -> Column:
    """A pileup's read string as one upper-case symbol a read: without starts and the quality that follows them, ends, and
    indels with as many bases as they say. Strings without indels, nearly all, take one replacement."""
    plain = F.upper(F.regexp_replace(bases, r"\^.|\$", ""))
    parts = F.split(plain, "[+-]")
    said = lambda p: F.regexp_extract(p, "^[0-9]+", 0)
    skipped = lambda p: F.length(said(p)) + said(p).cast("int")
    wrong = lambda p: F.raise_error(F.concat(F.lit("an indel without its bases: "), p)).cast("string")
    rest = lambda p: F.when((said(p) == "") | (F.length(p) < skipped(p)), wrong(p)).otherwise(F.substring(p, skipped(p) + 1, F.length(p)))
    spliced = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), rest), ""))
    return F.when(plain.contains("+") | plain.contains("-"), spliced).otherwise(plain)


def symbol_base(symbol: Column, ref: Column, where: Column) -> Column:
    """The base of a read's symbol."""
    return (
        F.when(symbol.isin(",", "."), ref)
        .when(symbol.isin(*KNOWN, "N", "*"), symbol)
        .when(symbol.isin("<", ">"), _fail("reference skip at ", where))
        .otherwise(_fail("not an allele: ", symbol))
    )


def explode_reads(pileup: DataFrame, consider_dels: bool = False, dels_have_quality: bool = False) -> DataFrame:
    """(chrom, pos, sample, read_ix, base, phred), a row for each read. Ignored deletions don't use up a quality, unless
    ``dels_have_quality``. Reference skips, too few qualities and indels without their bases fail."""
    one = pileup.select("chrom", "pos", "ref", F.explode("samples").alias("s")).filter("s.depth > 0")
    symbols = read_symbols(F.col("s.bases"))
    if not consider_dels and not dels_have_quality:
        symbols = F.translate(symbols, "*", "")
    spread = one.select("chrom", "pos", "ref", F.col("s.sample").alias("sample"), F.col("s.quals").alias("quals"), symbols.alias("symbols")).filter("symbols <> ''")
    spread = spread.select("chrom", "pos", "ref", "sample", "quals", F.posexplode(F.split("symbols", "")).alias("read_ix", "token")).filter("token <> ''")
    if dels_have_quality and not consider_dels:
        spread = spread.filter("token <> '*'")
    where = F.concat_ws(":", "chrom", "pos")
    mark = F.substring(F.col("quals"), F.col("read_ix") + 1, F.lit(1))
    quality = F.when(mark != "", phred(mark)).otherwise(_fail("more reads than qualities at ", where, "int"))
    return spread.select("chrom", "pos", "sample", "read_ix", symbol_base(F.col("token"), F.col("ref"), where).alias("base"), quality.alias("phred"))


# Targets, panels, genomes, maps

#: For each extension its separator and the columns of chromosome, position, reference and alternate.
TARGETS = {"snp": (r"\s+", (1, 3, 4, 5)), "vcf": ("\t", (0, 1, 3, 4)), "tsv": ("\t", (0, 1, 2, 3)), "csv": (",", (0, 1, 2, 3)), "txt": (r"\s+", (0, 1, 2, 3))}


def read_targets(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(chrom, pos, ref, alt). Of several lines with a coordinate the first one wins; in ``.snp`` files 23 is X."""
    sep, columns = TARGETS[(kind or path.rstrip("/").rsplit(".", 1)[-1]).lower()]
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("at", F.monotonically_increasing_id())
    f = F.split(F.trim("value"), sep)
    c, p, r, a = (f[i] for i in columns)
    chrom = chrom_id(c)
    if (kind or path).rstrip("/").endswith("snp"):
        chrom = F.when(chrom == 23, F.lit(X)).otherwise(chrom)
    rows = lines.select(chrom.alias("chrom"), p.cast("long").alias("pos"), F.upper(r).alias("ref"), F.upper(a).alias("alt"), "at")
    first = rows.groupBy("chrom", "pos").agg(F.min_by(F.struct("ref", "alt"), "at").alias("x"))
    return first.select("chrom", "pos", "x.ref", "x.alt")


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """(sample, grp, sex): a row for each sample and each of its two groups."""
    f = F.split(F.trim("value"), "\t")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    short = F.when(F.size(f) < 3, _fail("a panel line needs three fields: ", F.col("value"))).otherwise(f[0])
    return lines.select(short.alias("sample"), F.explode(F.array_distinct(F.array(f[1], f[2]))).alias("grp"), sex(F.get(f, F.lit(3))).alias("sex"))


def _names(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return sorted(r["path"] for r in files.collect())


def find_panel(spark: SparkSession, folder: str) -> str:
    found = _names(spark, folder, "*.panel")
    if len(found) != 1:
        raise ValueError(f"{folder} has {len(found)} .panel files; one is needed")
    return found[0]


def find_inputs(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("vcf", "vcf.gz")) -> list[str]:
    found = sorted(x for e in extensions for x in _names(spark, folder, f"*.{e}"))
    if not found:
        raise ValueError(f"{folder} has no input with one of {extensions}")
    return found


def read_genome(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(chrom, length) of a ``.fai`` index (a FASTA's own name is taken for its index); without a path, GRCh37.
    Contigs whose name is no chromosome are left out."""
    if path is None:
        return spark.createDataFrame(list(GRCH37.items()), "chrom int, length long")
    return _contigs(spark, path).filter("chrom IS NOT NULL").select("chrom", "length")


def skipped_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of the contigs that ``read_genome`` leaves out."""
    return _contigs(spark, path).filter("chrom IS NULL").select("name", "length")


def _contigs(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    return spark.read.text(path if path.endswith(".fai") else f"{path}.fai").select(f[0].alias("name"), chrom_id(f[0]).alias("chrom"), f[1].cast("long").alias("length"))


def genome_for(genome: DataFrame, x_mode: bool = False) -> DataFrame:
    return genome.filter(F.col("chrom") == X if x_mode else F.col("chrom") != X)


def _map_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(chrom, stop, rate, file, line) of every line but each file's first, the header, and empty ones; what can't be read
    is null."""
    lines = spark.read.option("pathGlobFilter", "*.[tT][xX][tT]").text(folder)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    heads = lines.filter("block = 0").groupBy("file").agg(F.min("at").alias("head"))  # a row for each file
    lines = lines.join(F.broadcast(heads), "file").filter((F.col("at") != F.col("head")) & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+")
    stop = F.when(F.get(f, F.lit(1)).rlike("^[0-9]+$"), F.get(f, F.lit(1)).try_cast("long"))
    return lines.select(chrom_id(f[0]).alias("chrom"), stop.alias("stop"), F.get(f, F.lit(2)).try_cast("double").alias("rate"), "file", F.col("value").alias("line"))


def read_genetic_map(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """(chrom, start, stop, rate) of the folder's ``.txt`` files: each line ends an interval that starts at the line before
    it, the first at 0. A file's first line is its header. A line whose chromosome, position or rate can't be read fails;
    without ``strict`` it is left out here and found by ``rejected_map_lines``."""
    rows = _map_lines(spark, folder)
    bad = F.col("chrom").isNull() | F.col("stop").isNull() | F.col("rate").isNull()
    if strict:
        rows = rows.withColumn("stop", F.when(bad, _fail("not a line of a genetic map: ", F.concat_ws(": ", "file", "line"), "long")).otherwise(F.col("stop")))
    else:
        rows = rows.filter(~bad)
    before = F.lag("stop", 1, 0).over(W.partitionBy("chrom").orderBy("stop"))
    return rows.select("chrom", before.alias("start"), "stop", "rate")


def rejected_map_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, line) of the lines that ``read_genetic_map`` can't read."""
    return _map_lines(spark, folder).filter("chrom IS NULL OR stop IS NULL OR rate IS NULL").select("file", "line")


# VCF


def vcf_header(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the ``#CHROM`` line."""
    line = spark.read.text(path).filter(F.col("value").startswith("#CHROM")).first()
    if line is None:
        raise ValueError(f"{path} has no #CHROM line")
    return line["value"].split("\t")[9:]


def parse_vcf(lines: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt, info, info_text, calls, calls_text) of VCF lines: one row a site, the calls as an array in the
    header's order and as they stand. Filters on the fixed columns run before the calls are split."""
    lines = lines.filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    fields = F.split("value", "\t", 10)
    head = lambda i: F.get(fields, F.lit(i))  # noqa: E731  null in a comment, should a plan look at one
    return lines.select(
        chrom_id(head(0)).alias("chrom"), head(1).cast("long").alias("pos"), F.upper(head(3)).alias("ref"), F.upper(head(4)).alias("alt"), info_map(head(7)).alias("info"), head(7).alias("info_text"), F.split(head(9), "\t").alias("calls"), head(9).alias("calls_text")
    )


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    return parse_vcf(spark.read.text(path))


def _samples(names: Sequence[str]) -> Column:
    """The names as one literal; an expression for each of them would be too many."""
    return F.split(F.lit("\t".join(names)), "\t") if names else F.array().cast("array<string>")


def read_vcf_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The sites of several VCFs as ``read_vcf`` gives them, with ``samples``, the header of each one's own file."""
    each = [read_vcf(spark, p).withColumn("samples", _samples(vcf_header(spark, p))) for p in paths]
    return reduce(DataFrame.unionByName, each)


def vcf_sites(vcf: DataFrame) -> DataFrame:
    return vcf.select("chrom", "pos", "ref", "alt", "info")


def vcf_genotypes(vcf: DataFrame, samples: Sequence[str] | None = None) -> DataFrame:
    """(chrom, pos, sample, a0, a1), a row for each call; rows without a coordinate keep their other columns instead. Without
    ``samples`` the column of that name has each row's."""
    keys = ["chrom", "pos"] if "pos" in vcf.columns else [c for c in vcf.columns if c not in ("calls", "samples")]
    named = vcf.select(*keys, (F.col("samples") if samples is None else _samples(samples)).alias("names"), F.transform("calls", lambda c: decode_gt(F.substring_index(c, ":", 1))).alias("gs"))
    call = lambda g, i: F.struct(F.element_at("names", i + 1).alias("sample"), g["a0"].alias("a0"), g["a1"].alias("a1"))
    return named.select(*keys, F.inline(F.transform("gs", call)))


def assign_vcf_index(panel: DataFrame, header: DataFrame) -> DataFrame:
    """panel with ``idx`` from header (sample, idx); null where the header lacks the sample."""
    return panel.join(F.broadcast(header), "sample", "left")


# Pedigrees


def read_pedigree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(iid, fid, mid, sex), (ord, label, i0, i1). Takes the standard form (3, 4 or 6 columns or a header, COMPARE
    lines) and the sectioned one (INDIVIDUALS, RELATIONSHIPS, COMPARISONS). A definition is one small file."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    lines = raw.select("at", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line")).filter("line <> ''")
    heads = F.when(F.col("line").isin("INDIVIDUALS", "RELATIONSHIPS", "COMPARISONS"), F.col("line"))
    section = F.last(heads, ignorenulls=True).over(W.orderBy("at"))
    lines = lines.withColumn("section", section).filter(heads.isNull())
    if lines.filter("section IS NOT NULL").limit(1).count():
        return _sections(lines)
    compare = lines.filter(F.upper("line").startswith("COMPARE"))
    f = F.split("line", r"\s+")
    order = F.row_number().over(W.orderBy("at")) - 1
    cmp = compare.select(order.alias("ord"), f[1].alias("label"), f[2].alias("i0"), f[3].alias("i1"))
    rest = lines.filter(~F.upper("line").startswith("COMPARE")).select("at", F.split("line", r"\s+").alias("f"))
    head = rest.orderBy("at").select("f").first()
    names = [x.lower() for x in head["f"]] if head else []
    has_head = bool({"iid", "id"} & {*names}) and "fid" in names
    if not has_head:
        names = {3: ["iid", "fid", "mid"], 4: ["iid", "fid", "mid", "sex"], 6: ["famid", "iid", "fid", "mid", "sex", "aff"]}.get(len(names), ["iid", "fid", "mid"])
    names = ["iid" if x == "id" else x for x in names]
    field = lambda n: F.get("f", F.lit(names.index(n))) if n in names else F.lit(None).cast("string")
    parent = lambda n: F.when(field(n) != "0", field(n))
    if has_head:
        first = rest.agg(F.min("at")).first()[0]
        rest = rest.filter(F.col("at") > first)
    return rest.select(field("iid").alias("iid"), parent("fid").alias("fid"), parent("mid").alias("mid"), sex(F.coalesce(field("sex"), F.lit(""))).alias("sex")), cmp


def _sections(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    call = lambda name, i: F.trim(F.regexp_extract("line", rf"^(.*?)\s*=\s*{name}\(\s*([^,]*)\s*,\s*([^)]*)\s*\)", i))
    born = lines.filter("section = 'RELATIONSHIPS'").select(call("repro", 1).alias("iid"), call("repro", 2).alias("fid"), call("repro", 3).alias("mid"))
    named = lines.filter("section = 'INDIVIDUALS'").select(F.col("line").alias("iid"))
    order = F.row_number().over(W.orderBy("at")) - 1
    cmp = lines.filter("section = 'COMPARISONS'").select(order.alias("ord"), call("compare", 1).alias("label"), call("compare", 2).alias("i0"), call("compare", 3).alias("i1"))
    return named.join(born, "iid", "left").withColumn("sex", F.lit("unknown")), cmp


def _registry_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).filter("line <> ''")
    return lines.select("value", F.split("line", r"\s+").alias("f"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(family, iid, fid, mid, sex) of files with a line for each person: family, person, father, mother (0: unknown) and,
    where they are told, sex and more columns. Lines are read on their own, in any number of files and tasks. A line with
    less than four fields is left out here and found by ``rejected_registry_lines``."""
    f = F.col("f")
    parent = lambda i: F.when(f[i] != "0", f[i])
    rows = _registry_lines(spark, path).filter(F.size("f") > 3)
    return rows.select(f[0].alias("family"), f[1].alias("iid"), parent(2).alias("fid"), parent(3).alias("mid"), sex(F.coalesce(F.get(f, F.lit(4)), F.lit(""))).alias("sex"))


def rejected_registry_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): the lines that ``read_registry`` can't read."""
    return _registry_lines(spark, path).filter(F.size("f") < 4).select(F.col("value").alias("line"))
