"""Mix sources to target weights.

Each source is put in a random order by the md5 of its ids and cut into blocks, which are ranges
of that order. A source takes whole passes over its blocks and then a first part of one more; the
last document of that part is cut, so the words taken meet the target. The block quotas of all
sources are split among the output shards by a tree: a node hands its left child a multivariate
hypergeometric draw of its blocks, so quotas are exact at every level and every shard gets a fair
sample. A shard draws the next blocks of each source's order and is shuffled on its own.

What is broadcast or met in one task is bounded by ``MAX_BLOCKS`` and the number of sources
(one row of the weight table each), never by documents: blocks grow with the input instead.

* Null text: size 0, takes nothing. Null source: a source of its own, the last. Null doc_id: hashed
  as the text ``null``. Empty tables give no rows.
* Rows of one source with equal doc_id share one place in the order; where the cut falls on
  them, each takes the same share of its words.
* Columns of the input are kept; working names start with ``_m_``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.llm.registry import query, table
from tuneframe.llm.text import word_count
from tuneframe.session import written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEAT = 2.0
MAX_BLOCKS = 1 << 16
BLOCK_WORDS = 1 << 14
SHARD_BLOCKS = 32
MAX_SHARDS = 1 << 12
SEED = "mix-1"
_PLACE_BITS = 60


def place(doc_id, seed: str = SEED):
    """Position of a document in its source's random order: 60 bits of a hash of its id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, _PLACE_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(_m_source, _m_null, size, _m_place), narrow and written: what the plan is made of."""
    rows = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_m_source"),
        F.col("source").isNull().alias("_m_null"),
        word_count(F.col("text")).alias("size"),
        place(F.col("doc_id"), seed).alias("_m_place"),
    )
    return written(rows, "mix-sizes")


def target_table(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: float = MAX_REPEAT, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per source: size, target, whole passes, words of the last part, number of blocks.

    Weights repeat over the sources by code point. A target stops at ``repeat`` times its source;
    the water level that the others share follows from running sums in the order of cap by weight.
    """
    sources = sizes.groupBy("_m_source", "_m_null").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy("_m_null", "_m_source")
    whole = Window.partitionBy(F.lit(1))
    rank = (F.row_number().over(every) - 1).alias("_m_rank")
    ranked = sources.select("*", rank)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_m_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("*", weight.alias("weight"), (F.col("source_size") * F.lit(repeat)).alias("_m_cap"))
    ranked = ranked.withColumn("_m_ratio", F.col("_m_cap") / F.col("weight"))
    lower = Window.orderBy("_m_ratio", "_m_rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("_m_ratio", "_m_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * F.lit(share)
    level = (total - F.coalesce(F.sum("_m_cap").over(lower), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("_m_level", level)
    # The first source in this order that stays below its cap fixes the level for all that follow.
    water = F.min(F.when(F.col("_m_level") < F.col("_m_ratio"), F.struct("_m_ratio", "_m_rank", "_m_level"))).over(whole)
    capped = leveled.withColumn("_m_water", water["_m_level"])
    target = F.when(F.col("_m_water").isNull() | (F.col("_m_ratio") <= F.col("_m_water")), F.col("_m_cap")).otherwise(F.col("_m_water") * F.col("weight"))
    per_block = F.greatest(F.lit(float(BLOCK_WORDS)), F.sum("source_size").over(whole) / F.lit(float(max_blocks)))
    known = capped.withColumn("target", target).withColumn("_m_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / per_block)).cast("long"))
    size = F.greatest(F.col("source_size"), F.lit(1))
    passes = F.floor(F.col("target") / size)
    return known.select(
        "_m_source", "_m_null", "_m_rank", "source_size", "target", "_m_blocks", passes.alias("_m_passes"),
        F.round(F.col("target") - passes * F.col("source_size")).cast("long").alias("_m_part"),
    )


def block_of(place_column, blocks):
    """Block of a place: ranges of the order, each the same share of the hash space."""
    return F.shiftright(F.shiftright(place_column, _PLACE_BITS - 30) * blocks, 30)


def _cuts(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source with a last part: the block and place where it ends, the words before that place and of it."""
    joined = sizes.join(sources.drop("source_size"), ["_m_source", "_m_null"]).withColumn("_m_block", block_of(F.col("_m_place"), F.col("_m_blocks")))
    blocks = joined.groupBy("_m_rank", "_m_block").agg(F.sum("size").alias("_m_words"), F.first("_m_part").alias("_m_part"))
    order = Window.partitionBy("_m_rank").orderBy("_m_block")
    upto = blocks.withColumn("_m_upto", F.sum("_m_words").over(order))
    edge = upto.filter((F.col("_m_upto") >= F.col("_m_part")) & (F.col("_m_upto") - F.col("_m_words") < F.col("_m_part")))
    edge = edge.select("_m_rank", "_m_block", (F.col("_m_upto") - F.col("_m_words")).alias("_m_before"))
    # One block per source: its places in order.
    inside = joined.join(edge, ["_m_rank", "_m_block"]).groupBy("_m_rank", "_m_block", "_m_place").agg(
        F.sum("size").alias("_m_peers"), F.first("_m_part").alias("_m_part"), F.first("_m_before").alias("_m_before")
    )
    walk = Window.partitionBy("_m_rank").orderBy("_m_place")
    inside = inside.withColumn("_m_upto", F.col("_m_before") + F.sum("_m_peers").over(walk))
    cut = inside.filter((F.col("_m_upto") >= F.col("_m_part")) & (F.col("_m_upto") - F.col("_m_peers") < F.col("_m_part")))
    return cut.select("_m_rank", F.col("_m_block").alias("_m_cut_block"), F.col("_m_place").alias("_m_cut"), "_m_peers", (F.col("_m_upto") - F.col("_m_peers")).alias("_m_before"))


def plan(sizes: DataFrame, **options) -> DataFrame:
    """The mix as one row per source: targets, where the last part is cut, and its number of block draws."""
    sources = written(target_table(sizes, **options), "mix-sources")
    cut = sources.join(_cuts(sizes, sources), "_m_rank", "left")
    last = F.when(F.col("_m_cut").isNull(), 0).otherwise(F.col("_m_cut_block") + 1)
    return written(cut.withColumn("_m_units", (F.col("_m_passes") * F.col("_m_blocks") + last).cast("long")), "mix-plan")


def _uniform(*key):
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / F.lit(float(2**53))


def hypergeometric(total, marked, drawn, uniform):
    """Draw of marked items among ``drawn`` of ``total``, of which ``marked`` are marked.

    Inverse distribution by a walk: outcomes are weighed outwards from the mode by the ratio of
    neighbouring probabilities, twelve standard deviations wide; what lies beyond is below 1e-30.
    """
    low = F.greatest(F.lit(0), drawn + marked - total)
    high = F.least(drawn, marked)
    n = F.greatest(total, F.lit(1)).cast("double")
    mode = F.least(high, F.greatest(low, F.floor((drawn + 1.0) * (marked + 1.0) / (n + 2.0))))
    spread = F.sqrt(drawn * (marked / n) * (1 - marked / n) * ((n - drawn) / F.greatest(n - 1, F.lit(1.0))))
    reach = (F.ceil(spread * 12) + 3).cast("long")
    def ratio(k):  # p(k + 1) / p(k)
        return (marked - k) * (drawn - k) / ((k + 1.0) * (n - marked - drawn + k + 1.0))

    def walk(first, last, step, factor, start, bar=None):
        """Sum of the weights over a walk, or with a bar the number of them whose running sum stays below it."""
        state = F.struct(F.lit(1.0).alias("p"), F.lit(start).alias("sum"), (F.lit(0) if bar is None else (F.lit(start) < bar).cast("int")).alias("n"))

        def move(a, k):
            p = a["p"] * factor(k)
            below = F.lit(0) if bar is None else (a["sum"] + p < bar).cast("int")
            return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), (a["n"] + below).alias("n"))

        steps = F.when((last - first) * step >= 0, F.sequence(first, last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(steps, state, move)

    def choose(m):
        def up(bar=None):
            return walk(m["mode"], m["end"] - 1, 1, ratio, 1.0, bar)

        def down(bar=None):
            return walk(m["mode"] - 1, m["first"], -1, lambda k: 1 / ratio(k), 0.0, bar)

        # Outcomes in the order mode, mode + 1, ..., end, mode - 1, ..., first.
        def pick(w):
            bar = uniform * (w["up"] + w["down"])
            lower = F.greatest(m["first"], m["mode"] - down(bar - w["up"])["n"])
            return F.when(bar <= w["up"], F.least(m["end"], m["mode"] + up(bar)["n"])).otherwise(lower)

        return _let(F.struct(up()["sum"].alias("up"), down()["sum"].alias("down")), pick)

    bounds = F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), mode.cast("long").alias("mode"), reach.alias("reach"))
    return _let(bounds, lambda b: _let(F.struct(
        F.greatest(b["low"], b["mode"] - b["reach"]).alias("first"), F.least(b["high"], b["mode"] + b["reach"]).alias("end"), b["mode"].alias("mode")), choose))


def _let(value, use):
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shard_quotas(mix: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """(shard, quotas): blocks of each source, in rank order, that each shard takes.

    A row is a node of the tree: its range of shards and its blocks by source. Sources are drawn one
    after the other out of what the left child still lacks, which makes the vector multivariate hypergeometric.
    """
    root = mix.agg(F.array_sort(F.collect_list(F.struct("_m_rank", "_m_units"))).alias("_m_pairs"))
    node = root.select(F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("width"), F.col("_m_pairs._m_units").alias("quotas"))
    for _ in range(math.ceil(math.log2(max(1, shards)))):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
        half = F.floor((F.col("width") + 1) / 2)
        node = node.select("*", half.alias("half"), total.alias("total"))
        goal = F.when(F.col("width") > 1, F.floor(F.col("total") * F.col("half") / F.col("width"))).otherwise(F.col("total"))
        node = node.withColumn("goal", goal.cast("long"))
        zero = F.struct(F.col("total").alias("total"), F.col("goal").alias("need"), F.array().cast("array<bigint>").alias("left"))

        def draw(acc, count):
            chance = _uniform(F.lit(seed), F.col("width"), F.col("first"), F.size(acc["left"]))
            got = hypergeometric(acc["total"], count, acc["need"], chance).cast("long")
            return _let(got, lambda g: F.struct((acc["total"] - count).alias("total"), (acc["need"] - g).alias("need"), F.concat(acc["left"], F.array(g)).alias("left")))

        left = F.when(F.col("width") > 1, F.aggregate("quotas", zero, draw)["left"]).otherwise(F.col("quotas"))

        def children(own):
            right = F.zip_with("quotas", own, lambda a, b: a - b)
            return F.array(
                F.struct(F.col("first").alias("first"), F.least(F.col("half"), F.col("width")).alias("width"), own.alias("quotas")),
                F.struct((F.col("first") + F.col("half")).alias("first"), (F.col("width") - F.col("half")).alias("width"), right.alias("quotas")),
            )

        node = node.select(F.explode(_let(left, children)).alias("c")).select("c.*").filter("width > 0")
    return node.select(F.col("first").alias("shard"), "quotas")


def shard_of_block(mix: DataFrame, quotas: DataFrame) -> DataFrame:
    """(_m_rank, _m_shards): for each source the shard of its first, second, ... block draw."""
    runs = quotas.select("shard", F.posexplode("quotas").alias("_m_rank", "n")).filter("n > 0")
    listed = runs.groupBy("_m_rank").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("runs"))
    shards = F.flatten(F.transform("runs", lambda r: F.array_repeat(r["shard"], r["n"].cast("int"))))
    return listed.select("_m_rank", shards.alias("_m_shards"))


def mix(docs: DataFrame, shards: int | None = None, seed: str = SEED, whole_documents: bool = False, **options) -> DataFrame:
    """Every document with its size, source_size, target, taken and draws.

    ``draws`` has an entry for each time that words of the document are taken: copy number, words
    (the first words of the text), output shard and ``shuffle_key``, the order inside the shard.
    With ``whole_documents`` the document at the cut is taken or left by the nearer end.
    No text is shuffled: the plan joins by source, a table of a row per source.
    """
    sizes = sized(docs, seed)
    known = plan(sizes, **options)
    if shards is None:
        units = known.agg(F.sum("_m_units")).first()[0] or 0
        shards = min(MAX_SHARDS, max(1, -(-units // SHARD_BLOCKS)))
    homes = shard_of_block(known, shard_quotas(known, shards, seed))
    known = written(known.join(homes, "_m_rank", "left"), "mix-shards")
    rows = docs.withColumns({
        "_m_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_m_null": F.col("source").isNull(),
        "_m_size": word_count(F.col("text")), "_m_place": place(F.col("doc_id"), seed),
    })
    keep = [F.col(c) for c in docs.columns if c not in ("size", "source_size", "target", "taken", "draws")]
    known = known.withColumnsRenamed({"source_size": "_m_source_size", "target": "_m_target"})
    rows = rows.join(known, ["_m_source", "_m_null"], "left")
    here, room = F.col("_m_place"), F.col("_m_part") - F.col("_m_before")
    share = F.floor(room * F.col("_m_size") / F.greatest(F.col("_m_peers"), F.lit(1)))
    if whole_documents:
        share = F.when(2 * room >= F.col("_m_peers"), F.col("_m_size")).otherwise(0)
    part = F.when(F.col("_m_cut").isNull() | (here > F.col("_m_cut")), 0).when(here < F.col("_m_cut"), F.col("_m_size")).otherwise(share).cast("long")
    rows = rows.withColumns({"_m_partial": part, "_m_block": block_of(here, F.col("_m_blocks"))})

    def entry(copy, words):
        unit = (copy * F.col("_m_blocks") + F.col("_m_block")).cast("int")
        return F.struct(
            copy.cast("int").alias("copy"), words.alias("words"), F.get("_m_shards", unit).alias("shard"),
            F.xxhash64(F.lit(seed), here, copy).alias("shuffle_key"),
        )

    full = F.when(F.col("_m_passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_m_passes") - 1), lambda c: entry(c, F.col("_m_size"))))
    last = F.array(entry(F.col("_m_passes"), F.col("_m_partial")))
    draws = F.filter(F.concat(F.coalesce(full, F.slice(last, 1, 0)), last), lambda d: d["words"] > 0)
    drawn = rows.select(*keep, "_m_size", "_m_source_size", "_m_target", draws.alias("_m_draws"))
    # What the tree has dealt to a shard is taken, and nothing else.
    taken = F.aggregate("_m_draws", F.lit(0).cast("long"), lambda a, d: a + F.when(d["shard"].isNotNull(), d["words"]).otherwise(0))
    return drawn.select(
        *keep, F.col("_m_size").alias("size"), F.col("_m_source_size").alias("source_size"), F.col("_m_target").alias("target"),
        taken.alias("taken"), F.col("_m_draws").alias("draws"),
    )


def mixed_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per draw: the given columns, copy, words, shard and shuffle_key."""
    return mixed.select(*columns, F.explode("draws").alias("_m_draw")).select(*columns, "_m_draw.*")


def shuffled_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of :func:`mixed_rows` in the order of the mix: shard after shard, each shuffled on its own."""
    return mixed_rows(mixed, columns).repartition("shard").sortWithinPartitions("shard", "shuffle_key")


def write_shards(mixed: DataFrame, columns: list[str], path: str) -> None:
    """Write the mix, a folder per shard. A shard is at most a fixed share of the words."""
    ordered = shuffled_rows(mixed, columns)
    ordered.write.mode("overwrite").partitionBy("shard").parquet(path)


_ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT *, (SELECT min_by(level, (ratio, rank)) FROM l WHERE level < ratio) AS water FROM l),
p AS (SELECT source, source_size, CASE WHEN water IS NULL OR ratio <= water THEN cap ELSE water * weight END AS target FROM t),
q AS (SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS passes FROM p),
o AS (SELECT *, round(target - passes * source_size)::BIGINT AS part FROM q),
j AS (SELECT d.doc_id, d.size, d.place, o.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.place) AS peers FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, size, source_size, target, (passes * size + CASE WHEN part = 0 OR upto - peers >= part THEN 0 WHEN upto <= part THEN size
    ELSE floor((part - (upto - peers))::DOUBLE * size / greatest(peers, 1)) END)::BIGINT AS taken FROM j
"""


@query("op1_mix", _ORACLE)
def op1(spark, folder):
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
