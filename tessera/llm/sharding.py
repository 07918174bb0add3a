"""Sharding by a k-d tree over document metadata, balanced by bytes.

DataFrame operations only. The tree splits a node at the weighted median of
its widest metadata dimension (relative to the dimension's width at the root),
weight being the bytes of the documents, until there are as many leaves as shards. The
dimensions are the logarithm of the text's bytes and the ranks of the whole
``source`` and ``lang`` among their distinct values.

Medians are distributed: the bytes of all open nodes of a level are summed into
equal-width bins of their dimensions (a partial aggregate), the driver takes the bin that
holds each median and the next round bins only that range, until the bin that is left holds
less than ``tolerance`` of the node or one single value. A heavy single value is split
further by the order of ``tie``: the hash of the text, then of the document, so that a
group of equal texts is one stretch. Where such a cut falls into a group it moves to the
group's nearer end if this shifts at most ``slack`` of a shard's bytes, else the group is
cut there. So a level tears at most one group a node, whatever the size of the
groups or of the table, and even a corpus of equal documents is balanced. Shifts add up
to less than twice ``slack`` of a shard.

What the driver sees is bins: at most ``BINS`` a level and round. The node of every
document is a column, written anew after each level; the splits of a level (one row a
node) are joined as a table.

Documents with equal texts are one point with the metadata of their smallest doc_id, found
with salted partial aggregates, as one text may be a third of all rows.

Defined cases: a null text counts 1 byte and has crc32 0; null metadata sorts
before all values; rows with the same doc_id are separate documents; texts of any length;
an empty table gives an empty result; other columns of the input, whatever their names,
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import partitions, work_area

#: Bins of all nodes of a level together (at least MIN_BINS a node).
BINS = 1 << 16
MIN_BINS = 16
SALTS = 64
DIMS = ("d0", "d1", "d2")
#: ``tie`` holds TIE_TEXT bits of the text's hash and TIE_DOC bits of the document's.
TIE_TEXT, TIE_DOC = 32, 20
_OPEN = "node int, col string, low double, high double, dim string, value double"
_CUTS = "node int, dim string, value double, tie double"


def ranked(own: DataFrame, name: str, area) -> DataFrame:
    """name and its place (0, 1, ...) among the distinct values, null being -1. Values are
    sorted by ranges; only the number of values of each range is seen at one place."""
    values = own.select(name).filter(F.col(name).isNotNull()).distinct()
    at = area.write(values.orderBy(name).withColumn("at", F.monotonically_increasing_id()), f"values_{name}")
    part = F.shiftright("at", 33)
    ranges = at.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    first = ranges.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    rank = (F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).cast("double")
    return at.withColumn("part", part).join(first, "part").select(name, rank.alias(f"rank_{name}"))


def _points(docs: DataFrame, area) -> DataFrame:
    """One row per document: size, crc32, the metadata of the point it moves with, and tie."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = lambda c, n: F.shiftrightunsigned(c, 64 - n)
    own = area.write(docs.select(
        "doc_id", "source", "lang",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("copy_of"),
    ).withColumn("own_hash", F.xxhash64("doc_id", "copy_of")).withColumn("salt", F.pmod("own_hash", F.lit(SALTS)).cast("int")), "own")
    head = F.min(F.struct("doc_id", "source", "lang")).alias("head")
    part = area.write(own.groupBy("copy_of", "salt").agg(head, F.count(F.lit(1)).alias("rows")), "part")
    whole = part.groupBy("copy_of").agg(F.min("head").alias("head"), F.sum("rows").alias("rows")).filter("rows > 1")
    heads = part.select("copy_of", "salt").join(whole, "copy_of").select("copy_of", "salt", F.col("head.source").alias("h_source"), F.col("head.lang").alias("h_lang"), F.lit(True).alias("h"))
    own = own.join(heads, ["copy_of", "salt"], "left")
    own = own.select(
        "doc_id", "size", "text_crc32", "copy_of", "own_hash",
        F.when(F.col("h").isNull(), F.col("source")).otherwise(F.col("h_source")).alias("source"),
        F.when(F.col("h").isNull(), F.col("lang")).otherwise(F.col("h_lang")).alias("lang"))
    own = area.write(own, "heads")
    for name in ("source", "lang"):
        own = own.join(ranked(own, name, area), name, "left")
    tie = F.shiftleft(bits(F.xxhash64("copy_of"), TIE_TEXT), TIE_DOC).bitwiseOR(bits(F.col("own_hash"), TIE_DOC)).cast("double")
    return area.write(own.select(
        "doc_id", "size", "text_crc32", F.log2(F.col("size").cast("double")).alias("d0"),
        *[F.coalesce(F.col(f"rank_{name}"), F.lit(-1.0)).alias(d) for d, name in (("d1", "source"), ("d2", "lang"))],
        tie.alias("tie"), F.lit(1).alias("node")), "points")


def _picked(name):
    """The value of the dimension whose name the column ``name`` holds."""
    out = F.col("tie")
    for d in DIMS:
        out = F.when(F.col(name) == d, F.col(d)).otherwise(out)
    return out


class _Open:
    """A node whose median is being looked for."""

    def __init__(self, stats, dim):
        self.bytes, self.dim, self.col = stats["bytes"], dim, dim
        self.low, self.high = stats[f"lo_{dim}"], stats[f"hi_{dim}"]
        self.ties = stats["lo_tie"], stats["hi_tie"]
        self.before, self.value = 0, None

    def narrow(self, bins: list, tolerance: float):
        """Take the bin of the median. Returns the cut (dim, value, tie) once it is found."""
        half, run, found = self.bytes / 2, self.before, None
        for found in bins:
            if run + found["w"] >= half:
                break
            run += found["w"]
        self.before = run
        single, fine = found["lo"] == found["hi"], found["w"] <= tolerance * self.bytes
        if not (single or fine):
            self.low, self.high = found["lo"], found["hi"]
            return None
        if self.col != "tie" and single and not fine:  # a heavy value: go on in its order of ties
            self.value, self.col, (self.low, self.high) = found["lo"], "tie", self.ties
            return None
        # the bin goes to the side that leaves the halves closer
        whole = abs(run + found["w"] - half) <= abs(run - half)
        if self.col == "tie":
            return self.dim, self.value, found["hi"] if whole else found["lo"] - 0.5
        return self.dim, found["hi"] if whole else found["lo"], float(1 << 53) if whole else -1.0


def _moved_to_groups(points: DataFrame, cuts: dict, slack: float) -> dict:
    """Cuts inside a group of equal texts, moved to its nearer end where that shifts at
    most ``slack`` bytes."""
    inside = {n: c for n, c in cuts.items() if 0 <= c[2] < float(1 << 53)}
    if not inside:
        return cuts
    # a cut of k or k - 0.5 is next to the tie k, whose upper bits are its text's
    rows = [(n, c[0], float(c[1]), float(c[2]), float((int(c[2] + 0.5) >> TIE_DOC) << TIE_DOC)) for n, c in inside.items()]
    table = points.sparkSession.createDataFrame(rows, _CUTS + ", start double")
    near = points.join(F.broadcast(table.withColumnRenamed("tie", "cut")), "node").filter(_picked("dim") == F.col("value"))
    near = near.filter((F.col("tie") >= F.col("start")) & (F.col("tie") < F.col("start") + (1 << TIE_DOC)))
    left = F.col("tie") <= F.col("cut")
    sums = near.groupBy("node", "start").agg(F.sum(F.when(left, F.col("size")).otherwise(0)).alias("l"), F.sum(F.when(left, 0).otherwise(F.col("size"))).alias("r")).collect()
    out = dict(cuts)
    for s in sums:
        dim, value, _ = cuts[s["node"]]
        if 0 < min(s["l"], s["r"]) <= slack:
            out[s["node"]] = dim, value, s["start"] - 0.5 if s["l"] <= s["r"] else s["start"] + (1 << TIE_DOC) - 0.5
    return out


def _split_level(points: DataFrame, level: list[int], spread: dict, tolerance: float, slack: float, area) -> DataFrame:
    """The points with the nodes of the next level (``2 n`` left, ``2 n + 1`` right)."""
    stats = points.groupBy("node").agg(
        F.sum("size").alias("bytes"), F.min("tie").alias("lo_tie"), F.max("tie").alias("hi_tie"),
        *[F.min(d).alias(f"lo_{d}") for d in DIMS], *[F.max(d).alias(f"hi_{d}") for d in DIMS]).collect()
    if not stats:
        return points
    if not spread:
        spread.update({d: (stats[0][f"hi_{d}"] - stats[0][f"lo_{d}"]) or 1.0 for d in DIMS})
    open_ = {s["node"]: _Open(s, max(DIMS, key=lambda d: ((s[f"hi_{d}"] - s[f"lo_{d}"]) / spread[d], d == DIMS[0]))) for s in stats}
    cuts: dict = {}
    while open_:
        bins = max(MIN_BINS, BINS // len(open_))
        table = points.sparkSession.createDataFrame([(n, o.col, float(o.low), float(o.high), o.dim, None if o.value is None else float(o.value)) for n, o in open_.items()], _OPEN)
        x = points.join(F.broadcast(table), "node").withColumn("x", _picked("col"))
        x = x.filter(F.col("x").between(F.col("low"), F.col("high")) & (F.col("value").isNull() | (_picked("dim") == F.col("value"))))
        width = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
        bin_ = F.least(F.floor((F.col("x") - F.col("low")) / width * bins), F.lit(bins - 1)).cast("int")
        found: dict = {}
        for r in x.groupBy("node", bin_.alias("bin")).agg(F.sum("size").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            found.setdefault(r["node"], []).append(r)
        for n in list(open_):
            cut = open_[n].narrow(sorted(found[n], key=lambda r: r["bin"]), tolerance)
            if cut:
                cuts[n] = cut
                del open_[n]
    cuts = _moved_to_groups(points, cuts, slack)
    table = points.sparkSession.createDataFrame([(n, c[0], float(c[1]), float(c[2])) for n, c in cuts.items()], _CUTS).withColumnRenamed("tie", "cut")
    at = points.join(F.broadcast(table), "node").withColumn("x", _picked("dim"))
    left = (F.col("x") < F.col("value")) | ((F.col("x") == F.col("value")) & (F.col("tie") <= F.col("cut")))
    at = at.withColumn("node", (F.col("node") * 2 + F.when(left, 0).otherwise(1)).cast("int"))
    return area.write(at.select(*points.columns), f"level_{len(level)}")


def kd_shards(docs: DataFrame, depth: int = 3, tolerance: float = 0.0005, slack: float = 0.02, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document, with
    2 ** depth shards of nearly equal bytes; with target_bytes the depth is the
    least at which a shard's mean has at most so many bytes. A slot is the document's gapless
    place in its shard, in the order of a hash of doc_id, then doc_id."""
    spark = docs.sparkSession
    area = work_area(spark)
    points = _points(docs, area)
    total = points.agg(F.sum("size")).first()[0] or 0
    if target_bytes:
        depth = max(0, -(-total // target_bytes) - 1).bit_length()
    spread: dict = {}
    for k in range(depth):
        points = _split_level(points, list(range(1 << k, 2 << k)), spread, tolerance, slack * total / (1 << depth), area)
    # slots: rows are numbered within many buckets of each shard, then shifted by the buckets before
    buckets = partitions(spark)
    placed = points.select(
        "doc_id", "size", "text_crc32", (F.col("node") - F.lit(1 << depth)).cast("int").alias("shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = counts.select(
        "shard", "bucket",
        (F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("rows")).alias("before"),
    )
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("own", own).join(before, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"),
    )


def op9_kd_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return kd_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
