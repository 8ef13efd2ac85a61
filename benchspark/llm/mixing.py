"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from benchspark.llm.common import staged, table

#: A text's words.
WORD = r"[^\x20\x09-\x0D]+"

# Weights of the sources in their order, repeating, the share of all words that is taken and how often a word is taken at most.
WEIGHTS, SHARE_PERCENT, MOST = (3, 1, 2), 150, 2

#: Words of a block.
BLOCK_WORDS = 16
#: Words of a shard of a source, and how many shards a source has at most (shards grow beyond).
SHARD_WORDS, MOST_SHARDS = 1 << 15, 4096
#: Copies of one (id, source, size) that lie in one piece; more are dealt to shards as several pieces.
PIECE_COPIES = 4096
#: A prime above the number of blocks of any shard: stepping by it modulo that number visits every block once.
STEP = 2147483659
SEED = "mix"


def _hash(*parts) -> Column:
    """60 bits of the md5 of the parts, joined by colons; NULL counts as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts).cast("binary")), 1, 15), 16, 10).cast("bigint")


def apportion(parties: DataFrame, weight: str, seats: str, order: str, by: list[str], name: str) -> DataFrame:
    """``parties`` with the long ``name``: how many of the ``seats`` of its group ``by`` a party wins by highest quotients
    weight / (2k - 1), k = 1, 2, ...; ties go to the smaller integer ``order``, then to the smaller k.

    No list of all quotients is made: rounding weight * seats / (sum of weights) gives every party the seats above one common
    quotient. That leaves at most about half a seat per party to add or to take back, and only the few quotients next to the
    border are ranked for it. A group whose weights sum to 0 gets no seats.
    """
    group = Window.partitionBy(*by)
    share = F.coalesce(F.col(weight).cast("double") / F.nullif(F.sum(F.col(weight).cast("double")).over(group), F.lit(0.0)), F.lit(0.0))
    # a divisor a hair off the ideal one, so that equal quotients at a round border all fall on one side of it
    begun = parties.withColumn("__share", share).withColumn("__k", F.floor(F.col("__share") * F.col(seats) * F.lit(1 - 1e-9) + 0.5).cast("bigint"))
    begun = begun.withColumn("__open", F.when(F.col("__share") > 0, F.col(seats) - F.sum("__k").over(group)).otherwise(0)).withColumn("__n", F.count("*").over(group))
    room = F.floor(F.col("__share") * (F.abs("__open") + F.col("__n"))).cast("bigint") + 2
    asked = (
        F.when(F.col("__open") > 0, F.sequence(F.col("__k") + 1, F.col("__k") + room))
        .when((F.col("__open") < 0) & (F.col("__k") > 0), F.sequence(F.greatest(F.lit(1).cast("bigint"), F.col("__k") - room + 1), F.col("__k")))
        .otherwise(F.array().cast("array<bigint>"))
    )
    sign = F.signum("__open").cast("int")
    bids = begun.select(*by, order, F.col("__open"), sign.alias("__sign"), (F.col(weight).cast("double")).alias("__w"), F.explode(asked).alias("__seat"))
    quotient = F.col("__w") / (2 * F.col("__seat") - 1)
    ranked = bids.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(-F.col("__sign") * quotient, F.col("__sign") * F.col(order), F.col("__sign") * F.col("__seat"))))
    moved = ranked.filter(F.col("__at") <= F.abs("__open")).groupBy(*by, order).agg(F.sum("__sign").alias("__moved"))
    out = begun.join(moved, [*by, order], "left")
    return out.select(*parties.columns, (F.col("__k") + F.coalesce("__moved", F.lit(0))).cast("bigint").alias(name))


def source_targets(sources: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``position`` (from 1, by code point, NULL last), ``weight``, ``target`` and ``capped``.

    The targets share ``share_percent`` % of all sizes by weight; a target above ``most`` times its size stops there and the
    excess is shared by weight again until none is above. Each round is one aggregate over the table of sources; only two
    numbers reach the driver.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ring = F.array(*[F.lit(w) for w in weights])
    named = staged(sources.withColumn("position", place).withColumn("weight", F.get(ring, (F.col("position") - 1) % len(weights)).cast("bigint")), "mix-sources")
    total = named.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    cap = F.col("source_size") * F.lit(most)
    capped, before = F.lit(False), None
    while True:
        full, left = named.agg(
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))
        ).first()
        if (full, left) == before or not left:
            break
        before = (full, left)
        num, den = share_percent * total - 100 * full, 100 * left
        big = lambda c: c.cast("decimal(38,0)")
        capped = big(cap) * F.lit(den).cast("decimal(19,0)") < big(F.col("weight")) * F.lit(num).cast("decimal(19,0)")
    if not left:
        return named.withColumn("target", cap.cast("double")).withColumn("capped", F.lit(True))
    fair = (F.col("weight") * F.lit(num).cast("bigint")).cast("double") / F.lit(den).cast("double")
    return named.withColumn("target", F.when(capped, cap.cast("double")).otherwise(fair)).withColumn("capped", capped)


def mix_sources(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights=WEIGHTS, share_percent: int = SHARE_PERCENT,
    most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, most_shards: int = MOST_SHARDS, seed: str = SEED,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many words of each row the mix takes, repeats counted.

    1. Sizes are counted in one narrow pass and staged as (id, source, size, copies); the texts are not read again.
    2. The targets of the sources, see ``source_targets``. A source at its stop takes every word ``most`` times. The blocks
       of ``block_words`` words of the others' targets go to them by Sainte-Laguë's highest quotients: integer quotas.
    3. Rows are dealt to their source's shards by a seeded hash, so a hot source is in as many shards as its words ask for.
       A source's quota is apportioned to its shards by their words, again by highest quotients: a quota per shard.
    4. In a shard the texts lie end to end in a seeded order, cut into equal blocks. A quota beyond the shard's words takes
       whole passes; the rest selects that many blocks, those that come first in a seeded permutation. A row takes what the
       passes and the selected blocks cover of it. Nothing but (id, source, size) is shuffled, and that once per shard.

    Defined results: NULL or empty texts have size 0 and take 0; rows of a NULL source are one source, the last; NULL ids are
    an id; repeated rows are taken each, rows alike in id, source and size in any order among themselves; other columns do not
    matter; a table without rows gives none. Equal seeds give equal mixes at any partitioning. The table of sources (a row
    per source) is ordered in one task.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    rows = staged(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    targets = source_targets(sources, weights, share_percent, most)
    blocks = targets.filter("not capped").agg(F.coalesce(F.round(F.sum("target") / block_words), F.lit(0)).cast("bigint")).first()[0]
    bidding = targets.withColumn("open", F.when(F.col("capped"), 0.0).otherwise(F.col("target"))).withColumn("blocks", F.lit(blocks)).withColumn("all", F.lit(0))
    shards = F.least(F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)), F.lit(most_shards)).cast("bigint")
    quotas = staged(apportion(bidding, "open", "blocks", "position", ["all"], "quota").withColumn("shards", shards).drop("open", "blocks", "all"), "mix-quotas")

    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / PIECE_COPIES))))
    pieces = pieces.withColumn("copies", F.least(F.lit(PIECE_COPIES), F.col("copies") - F.col("piece") * PIECE_COPIES))
    place = _hash(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("piece"))
    dealt = pieces.join(quotas, pieces["source"].eqNullSafe(quotas["source"])).drop(quotas["source"])
    dealt = staged(dealt.select("doc_id", "source", "position", "size", "copies", place.alias("place"), F.pmod("place", "shards").alias("shard"), "piece"), "mix-dealt")
    lengths = dealt.groupBy("position", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("length"))
    lengths = lengths.join(quotas.drop("source"), "position")
    shares = apportion(lengths, "length", "quota", "shard", ["position"], "shard_quota")
    words = F.when(F.col("capped"), F.col("length") * most).otherwise(F.least(F.col("shard_quota") * block_words, F.col("length") * most))
    passes = F.when(F.col("length") > 0, F.floor(words / F.col("length"))).otherwise(0).cast("bigint")
    plan = shares.select(
        "position", "shard", "source_size", "target", passes.alias("passes"),
        F.ceil(F.col("length") / block_words).cast("bigint").alias("n_blocks"),
        F.floor((words - passes * F.col("length")) / block_words + 0.5).cast("bigint").alias("chosen"),
        _hash(F.lit(seed), F.lit("shard"), F.col("position"), F.col("shard")).alias("turn"),
    )
    line = Window.partitionBy("position", "shard").orderBy("place", "doc_id", "size", "piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(line), F.lit(0))
    laid = dealt.withColumn("start", start).join(plan, ["position", "shard"])
    laid = laid.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    end = F.col("start") + F.col("size")

    def covered(total: Column, j: Column) -> Column:
        turn = F.pmod(j * F.lit(STEP) + F.col("turn") % F.col("n_blocks"), F.col("n_blocks"))
        return total + F.when(turn < F.col("chosen"), F.least((j + 1) * block_words, end) - F.greatest(j * block_words, F.col("start"))).otherwise(0)

    over = F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))
    picked = F.when((F.col("size") > 0) & (F.col("chosen") > 0), F.aggregate(over, F.lit(0).cast("bigint"), covered)).otherwise(0)
    return laid.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + picked).cast("bigint").alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_H = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"

#: The same by definition: all quotients listed and ranked, all blocks listed and looked at.
ORACLES = {
    "op13_mixing": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS position FROM d GROUP BY 1),
w AS (SELECT *, CAST([3, 1, 2][(position - 1) % 3 + 1] AS BIGINT) AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
-- sources in the order in which they reach their stop: the first that stays under it sets the rate
o AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
  sum(weight) OVER (ORDER BY 2.0 * source_size / weight, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
r AS (SELECT CAST(150 * total - 100 * stopped AS BIGINT) AS num, CAST(100 * open AS BIGINT) AS den FROM o
  WHERE weight * (150 * total - 100 * stopped) <= 2 * source_size * 100 * open ORDER BY 2.0 * source_size / weight, position LIMIT 1),
t AS (SELECT w.*, CAST(2 * source_size AS HUGEINT) * den < CAST(weight AS HUGEINT) * num AS capped,
  CASE WHEN CAST(2 * source_size AS HUGEINT) * den < CAST(weight AS HUGEINT) * num THEN CAST(2 * source_size AS DOUBLE)
    ELSE CAST(weight * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target,
  least(greatest(CAST(ceil(source_size / 32768.0) AS BIGINT), 1), 4096) AS shards FROM w, r),
b AS (SELECT CAST(coalesce(round(sum(target) / 16), 0) AS BIGINT) AS blocks FROM t WHERE NOT capped),
bid AS (SELECT position, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, position, k) AS nth
  FROM (SELECT position, target, unnest(range(1, CAST(source_size / 8 AS BIGINT) + 3)) AS k FROM t WHERE NOT capped AND target > 0)),
q AS (SELECT t.*, coalesce(n, 0) AS quota FROM t LEFT JOIN (SELECT position, count(*) AS n FROM bid, b WHERE nth <= blocks GROUP BY 1) USING (position)),
p AS (SELECT doc_id, source, size, count(*) AS copies FROM d GROUP BY ALL),
x AS (SELECT *, least(4096, copies - piece * 4096) AS many, {_H.format("concat_ws(':', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR), CAST(piece AS VARCHAR))")} AS place
  FROM (SELECT *, unnest(range(0, (copies - 1) // 4096 + 1)) AS piece FROM p)),
y AS (SELECT x.*, q.* EXCLUDE (source), place % shards AS shard FROM x JOIN q ON x.source IS NOT DISTINCT FROM q.source),
l AS (SELECT position, shard, CAST(sum(size * many) AS BIGINT) AS length, any_value(quota) AS quota, any_value(capped) AS capped FROM y GROUP BY 1, 2),
lbid AS (SELECT position, shard, quota, row_number() OVER (PARTITION BY position ORDER BY CAST(length AS DOUBLE) / (2 * k - 1) DESC, shard, k) AS nth
  FROM (SELECT *, unnest(range(1, CAST(length / 8 AS BIGINT) + 20)) AS k FROM l WHERE length > 0)),
lq AS (SELECT l.*, CASE WHEN capped THEN 2 * length ELSE least(16 * coalesce(n, 0), 2 * length) END AS words
  FROM l LEFT JOIN (SELECT position, shard, count(*) AS n FROM lbid WHERE nth <= quota GROUP BY 1, 2) USING (position, shard)),
pl AS (SELECT position, shard, CASE WHEN length > 0 THEN words // length ELSE 0 END AS passes, CAST(ceil(length / 16.0) AS BIGINT) AS n_blocks,
  CASE WHEN length > 0 THEN CAST(floor((words % length) / 16.0 + 0.5) AS BIGINT) ELSE 0 END AS chosen,
  {_H.format("concat_ws(':', 'mix', 'shard', CAST(position AS VARCHAR), CAST(shard AS VARCHAR))")} AS turn FROM lq),
z AS (SELECT *, CAST(coalesce(sum(size * many) OVER (PARTITION BY position, shard ORDER BY place, doc_id NULLS FIRST, size, piece
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM y),
c AS (SELECT doc_id, size, source_size, target, passes, n_blocks, chosen, turn, first + size * unnest(range(0, many)) AS start FROM z JOIN pl USING (position, shard))
SELECT doc_id, size, source_size, target, CAST(passes * size + CASE WHEN size > 0 AND chosen > 0 THEN coalesce(list_sum(list_transform(
    list_filter(range(start // 16, (start + size - 1) // 16 + 1), lambda j: (j * 2147483659 + turn % n_blocks) % n_blocks < chosen),
    lambda j: least((j + 1) * 16, start + size) - greatest(j * 16, start))), 0) ELSE 0 END AS BIGINT) AS taken FROM c
"""
}
