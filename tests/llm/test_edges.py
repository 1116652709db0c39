"""Every operator on nulls, empty and long texts, ties, repeated rows, an empty table and clashing extra columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from dqlens.llm import chat, common, extraction, fingerprints, jaccard, mixing, packing, quality, queries, sharding, toxicity, urls
from dqlens.llm.queries import tokenizer_path

LONG = "alpha beta gamma delta epsilon zeta eta theta. " * 4000
ROWS = [
    (1, "The cat sat on the mat. " * 20, "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, LONG, "en", "b"),
    (5, " \t\n", "en", "b"),
    (6, "one two", "fr", None),
    (7, "One TWO", "fr", "c"),
    (7, "One TWO", "fr", "c"),
    (8, "ÄÖ ß \x1c x\u00a0y \U0001f600 <|im_start|>", "de", "d"),
    (None, "no id here", "de", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = {"id": "x", "n": 1, "shard": "s", "node": 2, "size": None, "__b": 0, "n_words": "w", "h": 1, "taken": True, "length": 9, "s": 1, "toxic": 7}
MODEL = None


def model(spark):
    global MODEL
    if MODEL is None:
        rows = [(i, ("you idiot " if i % 3 == 0 else "") + f"the word{i} and that is it", "en") for i in range(60)]
        labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
        MODEL = toxicity.fit(toxicity.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels))
    return MODEL


OPERATORS = {
    "quality": lambda s, d: quality.quality(d),
    "mixing": lambda s, d: mixing.taken(d),
    "jaccard": lambda s, d: jaccard.jaccard(d),
    "fingerprints": lambda s, d: fingerprints.fingerprints(d),
    "sharding": lambda s, d: sharding.shard(d),
    "toxicity": lambda s, d: toxicity.score(d, model(s)),
    "packing": lambda s, d: packing.pack_documents(d, tokenizer_path()).where("piece = 0"),
    "extraction": lambda s, d: extraction.extract(d, "doc_id", "source", "text"),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_each(spark, docs, name):
    got = OPERATORS[name](spark, docs).collect()
    assert sorted((r[0] if r[0] is not None else -1) for r in got) == sorted(x[0] if x[0] is not None else -1 for x in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(spark, docs, name):
    key = lambda rows: sorted(map(str, rows))
    plain, more = OPERATORS[name](spark, docs), OPERATORS[name](spark, docs.withColumns({k: F.lit(v) for k, v in CLASH.items()}))
    if name == "packing":  # numbers of sequences may be any
        plain, more = plain.drop("sequence_id", "offset"), more.drop("sequence_id", "offset")
    assert key(plain.collect()) == key(more.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["quality", "mixing", "jaccard", "toxicity"])
def test_stage_keeps_columns(spark, docs, name):
    stage = {"quality": quality.keep_good, "mixing": mixing.mixed, "jaccard": jaccard.keep_one, "toxicity": lambda d: toxicity.keep_clean(d, model(spark))}[name]
    wide = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("row", F.lit(1)).withColumn("rank", F.lit("r"))
    assert stage(wide).columns == wide.columns
    stage(wide).collect()
    assert stage(wide.limit(0)).collect() == []


def test_chat_edges(spark):
    rows = [(1, 0, "system", "be <|im_end|> nice"), (1, 1, None, None), (1, 2, "assistant", ""), (1, 2, "assistant", ""), (None, 0, "user\n", "\\<|x"), (2, None, "assistant", LONG), (2, 1, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.windows(df.withColumn("conv", F.lit(1)))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 4, None: 1, 2: 2}
    assert got[2].loss_chars == len(LONG)
    assert chat.read_back(chat.windows(df.limit(0))).collect() == []


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.ORG/es/x?y#z"), (4, "http://A.Example.ORG/es/x?y#z"), (None, "x://h")], "page_id long, url string")
    labels = spark.createDataFrame([(4, 0), (None, 1), (3, None)], "id long, quality int")
    got = sorted(map(str, urls.judged(pages.withColumn("host", F.lit(1)).withColumn("key", F.lit(2)), labels).collect()))
    assert len(got) == 6
    assert sum("example.org/es/" in x and "block" in x for x in got) == 2
    assert urls.judged(pages.limit(0), labels).collect() == []
    assert urls.judged(pages, labels.limit(0)).count() == 6


@pytest.mark.parametrize("head", ["<title>T</title><body>", "<title>T</title>", "<meta charset=utf-8><noscript><p>N</p></noscript><template><p>X</p></template><script>var p = '<p>';</script><body>", "<link rel=x><noscript><img src=x></noscript><title>T</title><main>", "<style>p {}</style><title>T<body>", "<title>T</title></head><body>"])
def test_pages_without_the_end_of_the_head(head):
    text = "This is a long sentence of the main text, which stands in a paragraph of its own."
    page = f"<!doctype html><html><head>{head}<p>{text}</p><p>{text}</p>"
    assert extraction.main_text(page) == f"{text}\n{text}"


def test_text_ends_a_head():
    text = "This is a long sentence of the main text, which stands in no paragraph at all."
    assert extraction.main_text(f"<html><head><title>T</title>\n{text}") == text


def test_the_url_query_mines_rules_from_labels_that_bear_on_urls(spark, tmp_path):
    kinds = ["http://m.casino-win.example.net/en/{}.html", "http://news.example.net/en/{}.html", "https://blog.example.net/en/{}?page=2", "https://shop.example.net/it/{}"]
    pages = [(i, kinds[i % 4].format(i), "<p>x</p>") for i in range(400)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(0, 400, 3)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.page_id: r.verdict for r in queries.op8_url_filters(spark, str(tmp_path)).collect()}
    assert got == {i: "allow" if i % 4 else "block" for i in range(400)}


def test_no_labelled_row_is_too_long_to_fit_on(spark):
    d = spark.createDataFrame([(0, "x" * 3_000_000, "en"), *[(i, f"y{i % 3} same words" * 100, "en") for i in range(1, 21)]], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(21)], "doc_id long, toxic int")
    got = toxicity.sampled(d, labels)
    assert got["id"].tolist() == list(range(21)) and all(len(x) for x in got["features"][1:])
    few = toxicity.sampled(d, labels, rows=5)["id"].tolist()
    assert few == sorted(r.doc_id for r in d.orderBy(F.xxhash64("doc_id")).limit(5).collect())
    with pytest.warns(UserWarning, match="toxic"):
        toxicity.sampled(d, labels.withColumn("toxic", F.lit(0)))


def test_shards_of_slots_are_multinomial(spark):
    sources = mixing.targets(spark.createDataFrame([("a", 40_000, 9), ("b", 30_000, 9), ("c", 50_000, 9)], "source string, total long, rows long"))
    drawn = mixing.drawn(sources, block=10, shard_blocks=600).collect()
    counts = {(r.shard, r["rank"]): r.n for r in drawn}
    slots = mixing.slots(sources, block=10, shard_blocks=600).collect()
    assert {s for s, _ in counts} == set(range(20)) and sum(counts.values()) == len(slots) == len({(r["rank"], r.epoch, r.block) for r in slots})
    assert counts == Counter((r.shard, r["rank"]) for r in slots)
    for rank in range(3):
        own = [counts.get((s, rank), 0) for s in range(20)]
        mean = sum(own) / 20
        # 19 degrees of freedom: beyond these bounds once in 10,000 draws
        assert 4 < sum((x - mean) ** 2 / mean for x in own) < 52


def test_one_of_each_component_stays_whatever_its_id(spark):
    text = lambda p: " ".join(f"{p}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (3, text("c")), (3, text("d")), (3, text("d")), (4, text("d") + " more"), (None, text("c") + " more"), (5, None), (None, None)]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame([rows[k] for k in (0, 1, 2, 3, 7, 8)], "doc_id long, text string").collect())


def test_links_use_the_text_of_their_row(spark):
    text = lambda p: " ".join(f"{p}{i}" for i in range(60))
    rows = [(3, text("c")), (3, text("d")), (4, text("d") + " more"), (5, text("c") + " more")]
    got = jaccard.jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (3, 3), (4, 3), (5, 3)]


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_of_any_kind(spark, docs, name):
    """Ids may be strings; whole numbers keep all their digits beside nulls."""
    big = 2**62 + 1
    shifted = docs.withColumn("doc_id", F.col("doc_id") + big)
    got = OPERATORS[name](spark, shifted).collect()
    assert sorted(r[0] or 0 for r in got) == sorted(x[0] + big if x[0] is not None else 0 for x in ROWS)
    got = OPERATORS[name](spark, docs.withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))).collect()
    assert sorted(r[0] or "" for r in got) == sorted(f"k{x[0]}" if x[0] is not None else "" for x in ROWS)


def test_links_of_rows_without_or_with_text_ids(spark):
    text = lambda p: " ".join(f"{p}{i}" for i in range(60))
    rows = [(None, text("a")), ("x", text("a") + " more"), ("y", text("b")), (None, text("b") + " more"), (None, text("c")), (None, text("c") + " more")]
    got = jaccard.jaccard(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("None", "None"), ("None", "None"), ("None", "x"), ("None", "y"), ("x", "x"), ("y", "y")]


def test_a_verdict_can_be_filtered(spark, docs):
    every = quality.quality(docs)
    for column in ("kept", "base_failed"):
        assert sorted(map(str, every.where(column).collect())) == sorted(str(r) for r in every.collect() if r[column])
    assert every.where("kept AND n_words > 60").where("n_symbols < 5").count() == sum(r.kept and r.n_words > 60 and r.n_symbols < 5 for r in every.collect())


def test_no_local_folder_on_a_cluster(spark):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())


def test_rows_of_a_key_are_numbered_over_buckets(spark):
    d = spark.range(1000).select((F.col("id") % 2).alias("k"), "id", F.xxhash64("id").alias("h"))
    got = common.numbered(d, ["k"], ["h", "id"], F.shiftright("h", 58), "no", F.col("id"), "before").collect()
    for k in (0, 1):
        rows = sorted((r for r in got if r.k == k), key=lambda r: r.h)
        assert [r.no for r in rows] == list(range(500)) and [r.before for r in rows] == [sum(x.id for x in rows[:i]) for i in range(500)]


def test_cut_tables_can_be_discarded(spark, docs):
    kept = common.cut(docs)
    assert kept.count() == len(ROWS)
    common.discard(kept)
    with pytest.raises(Exception, match="(?i)not.*exist|no such file|does not exist"):
        spark.read.schema(docs.schema).parquet(kept._dqlens_path).collect()


def test_mixing_keeps_columns_of_equal_texts(spark):
    rows = [(1, "some words here", "a", x) for x in ("p", "q", None, "p")]
    got = Counter(r.extra for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, extra string")).collect())
    assert got == {"p": 2, "q": 1, None: 1}


def test_workers_hold_no_words_between_tasks(spark):
    """Full caches of idle workers took an executor's memory from the pipeline's other stages."""
    path, d = tokenizer_path(), spark.range(0, 20_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.hex("id")).alias("text"))

    def held(batches):
        import pandas as pd

        from dqlens.llm.tokens import word_ids

        ids = word_ids(path)
        for _ in batches:
            yield pd.DataFrame({"n": [len(x.new) + len(x.old) for x in (ids.runs, ids.tokens)]})

    first = sorted(packing.tokenized(d, path).collect())
    assert len(first) == 20_000
    assert {r.n for r in spark.range(0, 4, 1, 4).mapInPandas(held, "n long").collect()} == {0}
    assert sorted(packing.tokenized(d, path).collect()) == first
