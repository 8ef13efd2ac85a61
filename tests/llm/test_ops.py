"""The corpus operators against brute force, round trips and held-out accuracy, and on odd rows."""

import hashlib
import math
import pickle
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from benchspark.llm import ann, bpe, decontaminate, html_extract, jaccard, langid, licenses, quality, sharding, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


def rows_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 0.5, "k") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """NULL, empty, blank, long and repeated texts, a NULL id, and columns whose names the operators use themselves."""
    long = "word " * 3000 + "x" * 3000
    return rows_of(spark, [(1, None), (2, ""), (3, "  \n\t "), (4, "a b"), (5, "a b"), (5, "a b"), (6, long), (None, "a b"), (7, "é ü !! 12"), (8, None)])


@pytest.fixture(scope="module")
def none(spark):
    return rows_of(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- 1 byte-level BPE ---------------------------------------------------------------------------------------------

def tokenizer():
    import public_tokenizers
    import tiktoken

    rank_file, pattern = bpe.public_vocabulary()
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(rank_file), special_tokens={}), rank_file, pattern


@pytest.mark.parametrize("common", [bpe.COMMON_WORDS, 40])
def test_bpe_is_tiktoken(spark, docs, odd, common):
    enc, rank_file, pattern = tokenizer()
    some = docs.where("doc_id < 60").select("doc_id", "text").union(odd.select("doc_id", "text"))
    out = bpe.encode_documents(some, rank_file, pattern, most_common=common).withColumn("again", bpe.decode(F.col("ids"), rank_file)).collect()
    assert len(out) == some.count()
    for r in out:
        text = r.text or ""
        assert r.ids == enc.encode_ordinary(text)
        assert bytes(r.decoded) == bytes(r.again) == text.encode()


def test_bpe_book_holds_repeated_words_in_packed_pieces(spark):
    words = spark.createDataFrame([(f"w{i % 3000}",) for i in range(6000)] + [("once",), ("x" * 65,), ("x" * 65,)], "word string")
    common = bpe.common_words(words)
    assert {r.word for r in common.collect()} == {f"w{i}" for i in range(3000)}
    known, ids = bpe.pack_book(common.select("word", F.array(F.length("word"), F.lit(7)).alias("ids")), pa.uint16())
    sent = pickle.dumps((known, ids))
    assert len(sent) < 0.5 * (known.column.nbytes + ids.column.nbytes)
    known, ids = pickle.loads(sent)
    assert dict(zip(known.column.to_pylist(), ids.column.to_pylist())) == {f"w{i}": [len(f"w{i}"), 7] for i in range(3000)}
    known, ids = bpe.pack_book(common.limit(0).select("word", F.array(F.lit(7)).alias("ids")), pa.uint16())
    assert (len(known.column), len(ids.column)) == (0, 0)


def test_bpe_looks_the_book_up_among_the_words():
    book = pa.array([f"w{i}" for i in range(200_000)])
    for words in (["w5", "no", "w199999", "w5", ""], []):
        tracemalloc.start()
        before = pa.total_allocated_bytes()
        at = bpe.places(pa.array(words, pa.string()), book)
        assert at.tolist() == [int(w[1:]) if re.fullmatch(r"w\d+", w) else -1 for w in words]
        assert pa.total_allocated_bytes() - before < 1 << 20 and tracemalloc.get_traced_memory()[1] < 4 << 20
        tracemalloc.stop()


def test_bpe_digest_and_empty(spark, none):
    enc, rank_file, pattern = tokenizer()
    r = bpe.encode_documents(rows_of(spark, [(1, "it's  done\n\n ok"), (2, None)]), rank_file, pattern, digest=True, keep=["doc_id"]).orderBy("doc_id").collect()
    ids = np.array(enc.encode_ordinary("it's  done\n\n ok"), "<u4")
    assert (r[0].n_tokens, r[0].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    assert (r[1].n_tokens, r[1].decoded_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.encode_documents(none, rank_file, pattern).count() == 0


# --- 2, 6, 7 classifiers ------------------------------------------------------------------------------------------

def test_grammar_scores_clauses():
    g = toxicity.Grammar({"=idiot": 3.0, "moro": 2.0})
    bare, aimed = g.features("what an idiot")[0], g.features("you are an idiot")[0]
    assert aimed > bare > g.features("not an idiot")[0] > 0
    assert g.features("they said idiot was the word")[0] < bare
    assert g.features("nice weather. morons everywhere")[0] == 2.0
    assert g.features("I will kill you")[0] > 0 == g.features("they paint the kill")[0] * 0
    assert g.features("") == [0, 0, 0, 0]


def test_quality_holds_the_cells_of_one_chunk():
    words = random.Random(1).choices([f"w{i}" for i in range(50_000)], k=800_000)
    column = pa.array([" ".join(words[i : i + 400]) for i in range(0, len(words), 400)])
    alone = [next(iter(quality.indicator_cells(column.slice(i, 1)))) for i in (0, 999, 1999)]
    model = quality.QualityModel(np.ones(quality.DIMS), None, 0.5)
    tracemalloc.start()
    scores = [model.score(c) for c in quality.indicator_cells(column)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) == len(column) and peak < 24 << 20
    for i, c in enumerate(quality.indicator_cells(column)):
        if i in (0, 999, 1999):
            assert np.array_equal(c, alone.pop(0))


def test_descent_holds_no_second_copy_of_the_rows():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(quality.DIMS, 1000, replace=False)).astype(np.int32) for _ in range(1000)]
    y = np.where(np.arange(1000) % 2 == 0, 1.0, -1.0)
    ratio = rng.normal(size=quality.DIMS)
    tracemalloc.start()
    w, bias = quality.dual_coordinate_descent(rows, y, ratio, np.ones(1000), epochs=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 << 20
    assert np.mean([(w[r] @ ratio[r] + bias) * k > 0 for r, k in zip(rows, y)]) > 0.9


@pytest.mark.parametrize("which", ["toxic", "quality"])
def test_label_models(spark, odd, none, which):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit, score = (toxicity.fit_toxicity, toxicity.score_toxicity) if which == "toxic" else (quality.fit_quality, quality.score_quality)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fit(docs, labels.where(~held))
    got = score(docs, model).join(labels.where(held), "doc_id").select(which, F.col(f"{'toxicity' if which == 'toxic' else 'quality'}_score").alias("p")).collect()
    right = sum((r.p >= 0.5) == (r[which] == 1) for r in got) / len(got)
    assert right >= (0.9 if which == "toxic" else 0.97)
    out = score(odd, model).collect()
    assert len(out) == 10 and all(0 <= r[-1] <= 1 for r in out) and {r.score for r in out} == {0.5}
    assert score(none, model).count() == 0
    blank = fit(docs, labels.where("doc_id < 0"))
    assert {r[-1] for r in score(odd, blank).collect()} in ({0.0}, {0.5})


def test_language(spark, docs, odd, none):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = langid.fit_centroids(docs.where(~held))
    out = langid.identify_language(docs.where(held), model).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    by = {r.doc_id: r for r in langid.identify_language(odd, model).collect()}
    assert all(by[i].lang_pred == "und" and by[i].lang_rejected and by[i].lang_score == 0 for i in (1, 2, 3, 8))
    assert by[7].lang_pred != "und"
    assert langid.identify_language(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify_language(odd, langid.fit_centroids(none)).collect()} == {"und"}


# --- 3 n-gram Jaccard join ----------------------------------------------------------------------------------------

def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, percent, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, len(s), find(i)) for i, s in sets if i is not None}


@pytest.mark.parametrize("percent,k", [(90, 3), (80, 5)])
def test_jaccard_is_brute_force(spark, percent, k):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([4, 12, 20, 60, 200]))]
        for _ in range(8):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    passage = " ".join(rng.choice(words) for _ in range(80))
    rows += [(len(rows) + i, passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(3, 40)))) for i in range(30)]
    rows += [(900, None), (901, ""), (902, "A b"), (903, "a B"), (904, "one"), (905, "one"), (None, "one")]
    got = jaccard.jaccard_join(rows_of(spark, rows), percent, k).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_components(rows, percent, k)
    assert [r.component_id for r in got if r.doc_id is None] == [904]


def test_jaccard_counts_all_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16, raising=False)
    rng = random.Random(9)
    text = [f"w{rng.randrange(300)}" for _ in range(120)]
    rows = []
    for i in range(60):
        copy = list(text)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(300)}"
        rows += [(len(rows) + k, " ".join(copy)) for k in range(1 + i % 2)]
    rows += [(500, "only one"), (501, "own text"), (502, "own text"), (503, None), (None, "own text")]
    sets = [(i, shingles(t, 3)) for i, t in rows]
    want = {i: sum(j is not None and j != i and bool(a and b) and 100 * len(a & b) >= 90 * len(a | b) for j, b in sets) for i, a in sets}
    assert {r.doc_id: r.n_links for r in jaccard.jaccard_join(rows_of(spark, rows)).collect()} == want


def test_jaccard_odd(spark, odd, none):
    got = jaccard.jaccard_join(odd).collect()
    assert len(got) == 10
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (1, 2, 3, 8)} == {(i, i) for i in (1, 2, 3, 8)}
    assert jaccard.jaccard_join(none).count() == 0


def test_jaccard_ids_with_two_texts(spark):
    """A repeated id with two texts is two rows: no link of either is lost."""
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    got = jaccard.jaccard_join(rows_of(spark, [(5, a), (5, b), (6, a + " more"), (7, b + " more")])).collect()
    assert {(r.doc_id, r.component_id, r.n_links) for r in got} == {(5, 5, 1), (6, 5, 1), (7, 5, 1)}


def test_jaccard_of_chained_groups(spark, monkeypatch):
    """Chains of near copies and shared passages, with every token in one cell of the order: still brute force."""
    monkeypatch.setattr(jaccard, "COUNT_BITS", 2)
    monkeypatch.setattr(jaccard, "PIECE_BITS", 1)
    rng = random.Random(11)
    text, rows = [f"w{rng.randrange(500)}" for _ in range(90)], []
    for i in range(60):
        text[rng.randrange(len(text))] = f"v{rng.randrange(500)}"
        rows.append((200 - i, " ".join(text)))
    rows += [(300 + i, " ".join(text[:70] + [f"u{rng.randrange(900)}" for _ in range(rng.randint(1, 12))])) for i in range(60)]
    got = jaccard.jaccard_join(rows_of(spark, rows)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(rows, 90, 3)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in jaccard.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


# --- 4 HTML -------------------------------------------------------------------------------------------------------

ODDS = {"tag-p": 3.0, "tag-li": -3.0, "link3": -3.0, "size7": 2.0, "size6": 1.0}


def test_html_parts():
    page = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) { x("<p>no</p>") }</script></head><body>
    <nav><a href="/">Home</a></nav><div class="cookie notice"><p>We use cookies on this site, so please agree to it.</p></div>
    <article><header><h1>Head &amp; tail</h1></header><p>First <b>bold</b> text,<br>second   line &lt;ok&gt;.<p>Short.<ul><li>one<li>two</ul>
    <form><p>Your name, please enter it in this field here.</p></form><div class="comments"><p>A reader says that this is a very nice text.</p></div>
    </article><footer>&copy; me</footer></body></html> <foo"""
    assert html_extract.content(page, ODDS).split("\n")[-4:] == ["First bold text, second line <ok>.", "Short.", "one", "two"]
    assert html_extract.content("", ODDS) == "" and html_extract.content("<nav>x</nav>", ODDS) == ""


@pytest.mark.parametrize("page, texts", [
    ("<p>A</p><svg/><p>B</p>", ["A", "B"]),
    ("<p>A</p><canvas/><p>B</p>", ["A", "B"]),
    ("<article><p>A</p><math><p>B</p></article>", ["A", "B"]),
    ("<article><p>A</p><button><p>B</p><button>no</button></article>", ["A", "B"]),
    ("<p>A</p><svg><svg>no</svg>no</svg><p>B</p>", ["A", "B"]),
    ("<p>A</p><select><option>no</select><p>B</p>", ["A", "B"]),
    ("<head><meta a><title>no</title> no <p>A", ["A"]),
    ('<p>A</p><div class="x>B</div>', ["A", "B"]),
    ('<p>A</p><!-- <button> --><p>B</p><button>no</button>', ["A", "B"]),
])
def test_html_hidden_elements_end(page, texts):
    assert [b.text for b in html_extract.blocks(page)] == texts


@pytest.mark.parametrize("value, named", [
    ("article-with-sidebar", 1), ("post-share-content", 0), ("post-comments", -1), ("comments-list", -1), ("entry", 1),
    ("post comments", -1), ("row", 0), ("menu", -1), ("content no-sidebar", 1),
])
def test_html_class_values(value, named):
    assert html_extract._named("div", f' class="{value}"') == named
    page = f'<div class="{value}"><p>A text, which is long enough to say something.</p></div>'
    if named == 1:
        assert html_extract.content(page, {}) == "A text, which is long enough to say something."


def test_html_long_page():
    page = "<article>" + "<p>One more line, as long as this.<button>x<svg>" * 20_000 + "</article>"
    assert len(html_extract.blocks(page)) == 20_000


def test_min_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randint(1, 7)
        s, t = [rng.random() for _ in range(n)], [rng.random() for _ in range(n)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side):
            return sum(t[i] if side[i] else s[i] for i in range(n)) + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(html_extract._max_flow_side(n, s, t, edges)), best, abs_tol=1e-6)


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "", "x"), (2, "u", "<article><p>Long enough to be a text, I say.</p></article>", "x")], "page_id long, url string, html string, main_text string")
    got = [r.main_text for r in html_extract.extract_text(pages, html_extract.fit_blocks(pages)).orderBy("page_id", "html").collect()]
    assert got == ["", "", "Long enough to be a text, I say."]
    assert html_extract.extract_text(pages.limit(0), {}).count() == 0


# --- 5 sharding ---------------------------------------------------------------------------------------------------

def test_sharding(spark, docs, odd, none):
    got = sharding.shard_documents(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r._shard].append((r._slot, r._size))
    assert sorted(by) == list(range(24)) and len(got) == docs.count()
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    size = {k: sum(n for _, n in v) for k, v in by.items()}
    goal, largest = sum(size.values()) / 24, max(r._size for r in got)
    assert all(abs(v - goal) <= largest for v in size.values())
    assert all(r._size == len(r.text.encode()) + 8 for r in got)
    out = sharding.shard_documents(odd, 3).collect()
    assert len(out) == 10 and {r.key for r in out} == {"k"} and min(r._size for r in out) == 8
    assert sharding.shard_documents(none).count() == 0


def test_sharding_keeps_clashing_columns(spark):
    docs = rows_of(spark, [(i, f"text {i}") for i in range(40)]).withColumns({c: F.col("doc_id") + 1 for c in ("_key", "_ROW", "_piece", "__row")})
    got = sharding.shard_documents(docs, 4).collect()
    assert len(got) == 40 and all(r["_key"] == r["_ROW"] == r["_piece"] == r["__row"] == r.doc_id + 1 for r in got)


def test_sharding_splits_a_hot_text(spark):
    same = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot text").otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    n = [r["count"] for r in sharding.shard_documents(same, 8).groupBy("_shard").count().collect()]
    assert len(n) == 8 and max(n) - min(n) <= 0.05 * max(n)


# --- 8 decontamination --------------------------------------------------------------------------------------------

ITEM = "John has 12 apples and buys 5 kg of pears from Mary before he gives 12 apples to Tom at the market"


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (9, "two words")], "item_id long, text string")
    swap = ITEM.replace("12", "31").replace("John", "Anna").replace("Mary", "Paul").replace("kg", "lb")
    broken = ITEM.replace("12 apples and", "31 apples and").replace("Mary", "Paul")
    texts = [(1, f"Intro words here. {ITEM}. More text."), (2, f"so {ITEM.lower()} end"), (3, f"Hm. {swap}!"), (4, f"Hm. {broken}!"), (5, "John has 12 apples and buys nothing at all today, he said to them"), (6, "two words"), (6, "two words"), (7, None), (None, ITEM)]
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.find_contamination(rows_of(spark, texts), bench).collect()}
    assert got == {(1, 7): "verbatim", (2, 7): "verbatim", (3, 7): "refilled", (6, 9): "verbatim"}
    assert decontaminate.find_contamination(odd, bench).count() == 0
    assert decontaminate.find_contamination(none, bench).count() == decontaminate.find_contamination(odd, bench.limit(0)).count() == 0


LONG_ITEM = "we know that John pays 12 dollars for the bread which his friend Mary sells near the river in Paris every day of the year"


def contaminated(spark, item, *texts):
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = decontaminate.find_contamination(rows_of(spark, list(enumerate(texts))), bench).collect()
    return {r.doc_id: r.kind for r in found}


def test_decontamination_of_other_word_counts(spark):
    swap = LONG_ITEM.replace("12", "1,250").replace("John", "Anna").replace("Mary", "Mary Ann").replace("Paris", "New York")
    inserted = LONG_ITEM.replace("his friend", "his old friend")
    texts = (LONG_ITEM, f"So {swap}.", LONG_ITEM.replace("12", "3.5").replace("Mary", "Mary Ann"), inserted, inserted.replace("12", "3.5"), swap.replace(" the", " a"))
    assert contaminated(spark, LONG_ITEM, *texts) == {0: "verbatim", 1: "refilled", 2: "refilled", 3: "verbatim", 4: "refilled"}


def test_decontamination_of_number_words(spark):
    item = "sixteen boys share thirteen cakes with nineteen girls who have come to the party in the old garden"
    swap = item.replace("sixteen", "seventeen").replace("thirteen", "fourteen").replace("nineteen", "eighteen")
    assert contaminated(spark, item, item, swap, swap.replace("cakes", "pies").replace("party", "house").replace("garden", "town").replace("boys", "men").replace("girls", "women")) == {0: "verbatim", 1: "refilled"}
    german = "sechzehn kinder teilen dreizehn kuchen mit den anderen gästen die zum fest in den alten garten kamen"
    assert contaminated(spark, german, german.replace("sechzehn", "siebzehn").replace("dreizehn", "vierzehn")) == {0: "refilled"}


def test_decontamination_of_a_near_copy(spark):
    item = "Tom has 12 red apples and " + LONG_ITEM
    assert contaminated(spark, item, item, item.replace("has 12", "has 13")) == {0: "verbatim", 1: "verbatim"}


def test_decontamination_of_names_that_begin_sentences(spark):
    item = "Tom has 5 apples in the bag. Tom gives 2 apples to his sister. Tom eats one more of them later. How many apples are left in the bag now?"
    ana = item.replace("Tom", "Ana").replace("5", "7")
    mixed = item.replace("Tom has", "Ana has").replace("Tom gives", "Ben gives").replace("Tom eats", "Eva eats").replace("5", "7")
    assert contaminated(spark, item, item, f"Question: {ana} We asked Ana.", f"Once {ana}", mixed) == {0: "verbatim", 1: "refilled", 2: "refilled"}


def test_decontamination_of_short_items(spark):
    item = "Which river flows through Paris?"
    texts = (item, f"A long document begins here and goes on. {item} It ends with an answer.", "Which river flows through it, Paris?", "and so we ask which river flows through paris")
    assert contaminated(spark, item, *texts) == {0: "verbatim", 1: "verbatim", 3: "verbatim"}
    assert contaminated(spark, "What is the capital of France?", "One asks: What is the capital of Spain?", "the capital of France is what") == {0: "refilled"}


def test_decontamination_finds_all_passages(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [(b.item_id, norm(b.text)) for b in bench.collect()]
    want = {(d.doc_id, i) for d in docs.collect() for i, t in items if t in norm(d.text)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, bench).collect()} == want


# --- 9 nearest neighbours -----------------------------------------------------------------------------------------

def brute_nearest(vectors, k):
    ok = [(i, np.array(v, float)) for i, v in vectors if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    return {q: sorted(((-float(x @ v), i) for i, v in ok if i != q and len(v) == len(x)))[:k] for q, x in ok if q % 20 == 0}


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:600] = x[300]
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (None, [1.0] * 16), (40, [float(c) for c in x[40]])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), shard_rows=200).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    want = brute_nearest(vectors, 20)
    assert set(got) == set(want)
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values()))
    assert all(v == sorted(v) for v in got.values()) and [i for _, i in got[300]][:3] == [301, 302, 303]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (20, 21, 22)")
    assert ann.nearest(few, few.where("vec_id = 20")).count() == 2


def test_nearest_keeps_double_precision(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4)) / 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for r in ann.nearest(df, df.where("vec_id = 20"), k=5).collect():
        assert math.isclose(r.score, float(x[20] @ x[r.vec_id]), rel_tol=1e-12)


def test_nearest_visits_few_shards(spark, monkeypatch):
    """Each query visits every shard, so their number must not grow with a table that a few tasks can hold."""
    kept = {}

    def keep(df, purpose):
        kept[purpose] = staged(df, purpose)
        return kept[purpose]

    staged = ann.staged
    monkeypatch.setattr(ann, "staged", keep)
    x = np.random.default_rng(6).normal(size=(40_000, 8)).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 1000 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert kept["ann-graph"].select("shard").distinct().count() <= 8
    hit = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(set(found) & set(np.argsort(-score)[:20].tolist()))
    assert len(got) == 40 and hit >= 0.99 * 800


def test_shards_fit_tasks():
    assert ann._shards(615_384, 64, None) == 19 and ann._shards(51_282, 64, None) == 8 and ann._shards(500, 64, None) == 1
    assert ann._shards(6_000_000, 64, None) == -(-6_000_000 // 32_768) and ann._shards(900, 64, 200) == 5
    assert ann.SHARD_BYTES / 4 / (768 + ann.DEGREE) > 1_000_000 / ann._shards(1_000_000, 768, None)


@pytest.mark.parametrize("kind", ["spread", "clusters", "lengths"])
def test_graph_of_a_large_shard(kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 24))
    if kind == "clusters":
        x = x[rng.integers(0, 20, len(x))] + 0.05 * x
    if kind == "lengths":
        x *= np.exp(rng.normal(size=(len(x), 1)) / 2)
    x = x.astype(np.float32)
    x, q = x[:5800], x[5800:]
    wide = ann._augment(x, float(np.sqrt((x**2).sum(1).max())))
    graph, entry = ann.build_graph(wide)
    assert graph.shape == (len(x), ann.DEGREE) and (graph != np.arange(len(x))[:, None]).all()
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in graph)
    seen = np.zeros(len(x), bool)
    ann._reach(graph, entry, seen)
    assert seen.all()
    found = ann._search(wide, (wide**2).sum(1), graph, entry, np.concatenate([q, np.zeros((len(q), 1), np.float32)], 1), ann.BEAM)
    assert all(len(set(r)) == ann.BEAM for r in found) and found.min() >= 0
    want = np.argsort(-(q @ x.T), 1)[:, :20]
    assert np.mean([len(set(a[:40]) & set(b)) / 20 for a, b in zip(found, want)]) >= 0.98


def test_graph_of_a_few_points():
    for n in (1, 2, 5):
        x = np.eye(n, 6, dtype=np.float32)
        graph, entry = ann.build_graph(x)
        found = ann._search(x, (x**2).sum(1), graph, entry, x, 8)
        assert (found[:, 0] == np.arange(n)).all() and ((found >= 0).sum(1) == n).all()


# --- 10 license scan ----------------------------------------------------------------------------------------------

def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    found = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), sorted(i for i, _ in found), sorted({x for _, x in found})


def test_licenses(spark, docs, odd, none):
    own = rows_of(spark, [
        (1, "Released under the MIT License, the mit-license! MITKLicense"), (2, "Licensed under CC BY-NC 4.0."),
        (3, "GNU General Public License, version 3"), (4, "license mit apache general public"), (5, "Licensed under the Apache License, Version 2.0"),
    ])
    for df in (docs, odd, own):
        for r in licenses.scan_licenses(df).collect():
            assert (r._n_words, sorted(r._starts), r._base_labels) == brute_base(r.text)
            assert set(r._base_labels) <= set(r._labels) and 0 <= r._score <= 1
    labels = {r.doc_id: r._labels for r in licenses.scan_licenses(own).collect()}
    assert labels == {1: ["mit"], 2: ["cc-by-nc"], 3: ["gpl", "gpl-3.0"], 4: [], 5: ["apache", "apache-2.0"]}
    assert licenses.scan_licenses(none).count() == 0


def test_licenses_that_lack_a_rare_word(spark):
    own = rows_of(spark, [
        (1, "Use in source and binary forms, with or without modification, are permitted"), (2, "is hereby granted, free of charge, to any person obtaining a copy of this software"),
        (3, "Redistribution and use in source and binary form, with or without modification, are permitted"), (4, "in source and binary forms"),
    ])
    assert {r.doc_id: r._labels for r in licenses.scan_licenses(own).collect()} == {1: ["bsd"], 2: ["mit-text"], 3: [], 4: []}


def test_crc_of_id(spark):
    from benchspark.llm.common import crc_of_id

    got = spark.createDataFrame([Row(doc_id=i) for i in (0, 7, 123456)]).select("doc_id", crc_of_id().alias("c")).collect()
    assert all(r.c == zlib.crc32(str(r.doc_id).encode()) for r in got)
