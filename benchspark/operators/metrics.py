"""Text metrics of answers against references.

Rows carry ``model_key``, a unique ``pair_id``, ``answer`` and ``reference``. Tokens are split at white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchspark.functions.text import col, let, strip, text, words

# Parameters of the published metrics.
MAX_N = 4
ROUGE_BETA = 1.2
CIDER_SIGMA = 6.0
CIDER_SCALE = 10.0

#: Bits of a word of the common subsequence; sums of words need room to carry in 64 bits.
WORD_BITS = 32


def norm_answer(c) -> Column:
    """Text without the chat marker, trimmed."""
    return strip(F.replace(text(c), F.lit("assistant\n"), F.lit("")))


def finite(c) -> Column:
    """Non-finite as 0."""
    v = col(c)
    bad = F.isnan(v) | v.isin(float("inf"), float("-inf"))
    return F.when(v.isNull() | ~bad, v).otherwise(0.0)


def sentence_sim(rows: DataFrame, answer_vec: str = "answer_vec", reference_vec: str = "reference_vec") -> DataFrame:
    """Mean cosine of answer and reference vectors per model (H36); a zero vector gives 0."""

    def dot(a, b):
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(answer_vec, answer_vec)) * F.sqrt(dot(reference_vec, reference_vec))
    cos = F.when(size > 0, dot(answer_vec, reference_vec) / size).otherwise(0.0)
    return rows.groupBy("model_key").agg(finite(F.avg(cos)).alias("sentence_sim"))


def _ngrams(toks: Column) -> Column:
    """Arrays of 1- to 4-grams: each order is the one below with the next token appended."""

    def longer(shorter, k):
        head = F.slice(shorter, F.lit(1), F.greatest(F.size(shorter) - 1, F.lit(0)))
        return F.zip_with(head, F.slice(toks, k, F.size(toks)), lambda g, t: F.concat(g, F.lit(" "), t))

    return let(
        longer(toks, 2), lambda g2: let(longer(g2, 3), lambda g3: let(longer(g3, 4), lambda g4: F.array(toks, g2, g3, g4)))
    )


def grams(rows: DataFrame) -> DataFrame:
    """Counts of each n-gram in the answer and in the reference of a pair.

    The texts are shuffled by pair, so that all grams of a pair are in one partition and none is shuffled to be counted. The
    number of partitions is given: it should follow the grams, not the much smaller texts.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = rows.select(
        "model_key", "pair_id", words(norm_answer("answer")).alias("ta"), words(norm_answer("reference")).alias("tr")
    ).repartition(parts, "model_key", "pair_id").select("model_key", "pair_id", _ngrams(F.col("ta")).alias("ga"), _ngrams(F.col("tr")).alias("gr"))
    orders = F.array(
        *[
            F.struct(F.lit(n).alias("n"), F.lit(side).alias("side"), F.get(g, F.lit(n - 1)).alias("grams"))
            for side, g in ((0, "ga"), (1, "gr"))
            for n in range(1, MAX_N + 1)
        ]
    )
    exploded = t.select("model_key", "pair_id", F.inline(orders)).select(
        "model_key", "pair_id", "n", "side", F.explode("grams").alias("gram")
    )
    return exploded.groupBy("model_key", "pair_id", "n", "gram").agg(
        F.sum(1 - F.col("side")).alias("c"), F.sum("side").alias("r")
    )


def lengths(rows: DataFrame) -> DataFrame:
    return rows.select(
        "model_key", "pair_id", F.size(words(norm_answer("answer"))).alias("len_a"),
        F.size(words(norm_answer("reference"))).alias("len_r"),
    )


def bleu(rows: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Corpus BLEU-4 per model with brevity penalty."""
    g = counted if counted is not None else grams(rows)
    per_n = g.groupBy("model_key", "n").agg(F.sum(F.least("c", "r")).alias("hit"), F.sum("c").alias("total"))
    precision = per_n.groupBy("model_key").agg(
        F.sum(F.when((F.col("hit") > 0), F.ln(F.col("hit") / F.col("total")))).alias("log_p"),
        F.count_if(F.col("hit") > 0).alias("orders"),
    )
    size = lengths(rows).groupBy("model_key").agg(F.sum("len_a").alias("a"), F.sum("len_r").alias("r"))
    penalty = F.when(F.col("a") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("a")))
    score = F.when(F.col("orders") == MAX_N, penalty * F.exp(F.col("log_p") / MAX_N)).otherwise(0.0)
    return size.join(precision, "model_key", "left").select("model_key", finite(F.coalesce(score, F.lit(0.0))).alias("bleu"))


def _masks(toks: Column) -> Column:
    """Distinct token -> its places as bits, 32 to a word."""

    def mask(tok, word):
        part = F.slice(toks, word * WORD_BITS + 1, F.lit(WORD_BITS))
        bits = F.transform(part, lambda t, i: F.when(t == tok, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, v: s.bitwiseOR(v))

    count = F.ceil(F.size(toks) / WORD_BITS).cast("int")
    names = F.array_distinct(toks)
    return F.map_from_arrays(names, F.transform(names, lambda t: F.transform(F.sequence(F.lit(0), count - 1), lambda w: mask(t, w))))


def lcs_length(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence of two token arrays.

    Bit-parallel: a bit per token of ``left`` in words of 32, one step per token of ``right``; the sum of a step carries from
    word to word. ``left`` should be the shorter one.
    """
    full = F.lit((1 << WORD_BITS) - 1).cast("bigint")
    n = F.size(left)
    words_of = F.sequence(F.lit(0), F.ceil(n / WORD_BITS).cast("int") - 1)
    whole = F.transform(words_of, lambda w: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(F.lit(WORD_BITS), n - w * WORD_BITS)) - 1)

    def step(masks, row, tok):
        def word(state, pair):
            kept = pair["r"].bitwiseAND(pair["m"])
            total = pair["r"] + kept + state["carry"]
            out = total.bitwiseAND(full).bitwiseOR(pair["r"] - kept)
            return F.struct(F.shiftright(total, WORD_BITS).alias("carry"), F.array_append(state["row"], out).alias("row"))

        start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("row"))
        paired = F.zip_with(row, masks[tok], lambda r, m: F.struct(r.alias("r"), m.alias("m")))
        return F.when(F.map_contains_key(masks, tok), F.aggregate(paired, start, word, lambda st: st["row"])).otherwise(row)

    def count(masks):
        rows = F.aggregate(right, whole, lambda row, tok: step(masks, row, tok))
        zeros = F.zip_with(rows, whole, lambda r, full_word: F.bit_count(full_word) - F.bit_count(r.bitwiseAND(full_word)))
        return F.aggregate(zeros, F.lit(0), lambda s, v: s + v)

    return F.when((n > 0) & (F.size(right) > 0), let(_masks(left), count)).otherwise(0)


def rouge_l(rows: DataFrame) -> DataFrame:
    """Mean ROUGE-L per model."""
    d = rows.select("model_key", words(norm_answer("answer")).alias("a"), words(norm_answer("reference")).alias("r"))
    # the shorter text is held as bits
    d = d.withColumns({"s": F.when(F.size("a") < F.size("r"), F.col("a")).otherwise(F.col("r")), "l": F.when(F.size("a") < F.size("r"), F.col("r")).otherwise(F.col("a"))})
    d = d.select("model_key", F.size("a").alias("la"), F.size("r").alias("lr"), lcs_length(F.col("s"), F.col("l")).alias("lcs"))
    p, q = F.col("lcs") / F.col("la"), F.col("lcs") / F.col("lr")
    b2 = ROUGE_BETA**2
    score = F.when(F.col("lcs") > 0, (1 + b2) * p * q / (q + b2 * p)).otherwise(0.0)
    return d.groupBy("model_key").agg(finite(F.avg(score)).alias("rouge_l"))


def cider(rows: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Mean CIDEr-D per model, n = 1..4.

    A gram has one document frequency per model, so the join's right side is unique and a hot gram is only ever split. Grams
    of fewer than two references weigh as those of one, so they need no row there.
    """
    g = counted if counted is not None else grams(rows)
    docs = rows.groupBy("model_key").agg(F.count("*").alias("docs"))
    keys = ["model_key", "n", "gram"]
    df = g.where("r > 0").groupBy(*keys).agg(F.count("*").alias("df")).where("df > 1")
    weighted = g.join(df, keys, "left").join(docs, "model_key")
    idf = F.ln("docs") - F.ln(F.greatest(F.lit(1), F.coalesce("df", F.lit(0))))
    v = weighted.select("model_key", "pair_id", "n", (F.col("c") * idf).alias("h"), (F.col("r") * idf).alias("f"))
    per_n = v.groupBy("model_key", "pair_id", "n").agg(
        F.sum(F.least("h", "f") * F.col("f")).alias("dot"), F.sum(F.col("h") * F.col("h")).alias("hh"),
        F.sum(F.col("f") * F.col("f")).alias("ff"),
    )
    sim = F.when((F.col("hh") > 0) & (F.col("ff") > 0), F.col("dot") / (F.sqrt("hh") * F.sqrt("ff"))).otherwise(0.0)
    per_pair = per_n.groupBy("model_key", "pair_id").agg((F.sum(sim) / MAX_N).alias("sim"))
    gap = F.col("len_a") - F.col("len_r")
    scored = lengths(rows).join(per_pair, ["model_key", "pair_id"], "left").select(
        "model_key",
        (CIDER_SCALE * F.coalesce("sim", F.lit(0.0)) * F.exp(-(gap * gap) / (2 * CIDER_SIGMA**2))).alias("score"),
    )
    return scored.groupBy("model_key").agg(finite(F.avg("score")).alias("cider"))


def semantic_table(rows: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """All metrics per model with sample count; a metric that cannot be computed is NULL and named."""
    counted = grams(rows)
    out = rows.groupBy("model_key").agg(F.count("*").alias("sample_count"))
    for part in (cider(rows, counted), bleu(rows, counted), rouge_l(rows)):
        out = out.join(part, "model_key", "left")
    errors = ["meteor: scorer unavailable"]
    if vectors is not None:
        out = out.join(sentence_sim(vectors), "model_key", "left")
    else:
        out = out.withColumn("sentence_sim", F.lit(None).cast("double"))
        errors.insert(0, "sentence_sim: no vectors")
    return out.withColumns({"meteor": F.lit(None).cast("double"), "metric_errors": F.lit(" | ".join(errors))})
