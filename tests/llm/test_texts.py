"""Main text of pages, pieces of texts, and the pipeline."""

import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusatlas.llm import main_text, pieces
from corpusatlas.llm.queries import QUERIES, model_file

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = [
    None, "", " ", "   ", "Hello  world.\n\n The 2024 token", "a b", "naïve Ünïcode — “quotes”", "日本語のテキスト", "\U0001f600 smile",
    "x" * 300 + "the" * 200, "tabs\tand\r\nlines", "0123456789" * 20, "the the the of and in", "word" * 40 + " é" * 70,
]


@pytest.fixture(scope="module")
def unigram_file(tmp_path_factory):
    """The same pieces as a unigram model, with scores that keep exact sums."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(model_file(), "rb").read())
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    for piece in proto.pieces:
        if piece.type == piece.NORMAL and piece.score < -1e6:
            piece.score = -40_000
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def check(spark, texts, file, chunk_bytes=1 << 20):
    library = sentencepiece.SentencePieceProcessor(model_file=file)
    vocabulary = pieces.Vocabulary.load(file)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    encoded = pieces.encoded(df, vocabulary, chunk_bytes)
    found = {r.doc_id: r for r in pieces.decoded(encoded, vocabulary).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        assert found[i].ids == library.encode(text or ""), text
        assert found[i].text == (text or "")


def test_more_chunks_than_twelve_bits(spark):
    """Every text is a chunk of its own, thousands of them in a partition."""
    vocabulary = pieces.Vocabulary.load(model_file())
    texts = [f"word{i % 7} number {i}" for i in range(4_500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = pieces.decoded(pieces.encoded(df, vocabulary, chunk_bytes=1), vocabulary)
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == 4_500 and all(got[i].text == t and got[i].round_trip for i, t in enumerate(texts))


def test_buckets_of_words_are_not_joined_into_few_tasks(spark):
    vocabulary = pieces.Vocabulary.load(model_file())
    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    texts = [f"text {i} holds words like number{i * 7919}" for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = pieces.encoded(df, vocabulary, chunk_bytes=1).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.doc_id, r.ids) for r in rows) == [(i, library.encode(t)) for i, t in enumerate(texts)]
    # Small partitions may be joined by size up to one task for all; these are as many as buckets.
    assert len({r.task for r in rows}) > int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 30])
def test_merge_model_gives_the_ids_of_its_library(spark, chunk_bytes):
    check(spark, TEXTS, model_file(), chunk_bytes)


def test_unigram_model_gives_the_ids_of_its_library(spark, unigram_file):
    # Short texts: the library adds scores up in single precision.
    check(spark, [t for t in TEXTS if not t or len(t) < 250], unigram_file)


def test_given_documents_round_trip(spark, sf):
    found = QUERIES["op3_sentencepiece"](spark, sf)
    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = found.collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    assert all(r.ids == library.encode(texts[r.doc_id]) for r in rows)


def test_words_and_late_merges_in_plain_python():
    vocabulary = pieces.Vocabulary.load(model_file())
    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    draw = random.Random(3)
    for _ in range(300):
        word = "".join(draw.choice("theinaonrsdé") for _ in range(draw.randrange(1, 90)))
        assert vocabulary.encode_word(pieces.MARK + word) == library.encode(word)


def test_empty_table_has_no_pieces(spark):
    vocabulary = pieces.Vocabulary.load(model_file())
    assert pieces.encoded(spark.createDataFrame([], "doc_id long, text string"), vocabulary).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies on this site, and you have to say that it is well.</div>
<article><h1>A &amp; B</h1><p>First   paragraph
of&nbsp;the text.</p><p><b>Second<br><p>Third &lt;x&gt;</p><div class="ad">Buy it now</div><p>Last.</p></article>
<aside><p>The side of the page with words that are of no use to the reader of it.</p></aside>
<div id="comments"><article><p>A reader says that it is not the case at all.</p></article></div>
<form><p>Sign up to the news.</p><button>Go</button></form><footer>&copy; 2020</footer></body></html>"""


def test_main_text_of_a_marked_article():
    assert main_text.main_text(PAGE) == "A & B\nFirst paragraph of the text.\nSecond\nThird <x>\nLast."


def test_main_text_by_block_rules():
    body = (
        "<div><a href=1>One</a> <a href=2>Two</a></div><h1>Title</h1>"
        "<p>This is the long paragraph of the page, and it has all of the words that one would want in it.</p><p>Short.</p>"
        "<p>Another paragraph that is as long as the first one and has as many of the words of the kind.</p>"
        "<div>xkcd qwrt zxcv bnmk lkjh gfds poiu ytre wqas dfgh jklz xcvb nmqw erty uiop asdf ghjk</div><p>End</p>"
    )
    text = main_text.main_text(f"<html><body>{body}</body></html>")
    assert text.split("\n")[0] == "Title" and "Short." in text and "xkcd" not in text and "One" not in text


def test_main_text_after_a_marked_paragraph():
    for mark in ('<p class="share">Share</p>', '<p class="share">Share', '<h2 class="related">Share</h2>', '<ul><li class="share">Share<li>Item</ul>'):
        kept = "Item\n" if "Item" in mark else ""
        page = f"<body><article><p>One.</p>{mark}<p>Two.</p><h3>Three</h3><p>Four.</p></article></body>"
        assert main_text.main_text(page) == f"One.\n{kept}Two.\nThree\nFour."
    page = '<article><table><tr><td class="ad">Buy</td><td>Cell</td></tr><tr class="ad"><td>Buy</td></tr><tr><td>Last</td></tr></table></article>'
    assert main_text.main_text(page) == "Cell\nLast"


def test_main_text_keeps_links_of_the_article():
    page = "<article><p>One.</p><p>See <a href=1>this one here</a>.</p><ul><li><a href=2>Reference</a></li></ul></article><p><a href=3>Out</a></p>"
    assert main_text.main_text(page) == "One.\nSee this one here.\nReference"
    long = "This is the long paragraph of the page, and it has all of the words that one would want in it."
    assert main_text.main_text(f"<p>{long}</p><p>It is a short one, with <a href=1>a link</a>.</p><p>{long}</p><p><a href=1>Out</a></p>").split("\n") == [
        long, "It is a short one, with a link.", long
    ]


def test_main_text_of_pages_whose_names_only_mention_what_is_out():
    long = "This is the long paragraph of the page, and it has all of the words that one would want in it."
    notice = '<div class="share-buttons">It is the place to share that with all of the others.</div>'
    for page in (
        f'<body class="no-sidebar sidebar"><div><p>{long}</p></div>{notice}</body>',
        f'<body><div class="layout with-sidebar"><p>{long}</p></div>{notice}</body>',
        f'<body><article class="post tag-search category-social"><p>{long}</p></article>{notice}</body>',
        f'<body><article class="related"><p>{long}</p></article>{notice}</body>',
        f'<body><div class="sidebar"><p>{long}</p><p>{long[:-1]}!</p></div>{notice}</body>',
    ):
        assert main_text.main_text(page).startswith(long) and "others" not in main_text.main_text(page)


LONG = "This is the long paragraph of the page, and it has all of the words that one would want in it."
NAV = "<div><a href=1>Home</a> <a href=2>News</a> <a href=3>Shop</a></div>"
RUSSIAN = (
    "Вчера вечером на площади собрались жители города, чтобы обсудить новый план. Они говорили о том, что в центре не хватает деревьев, и о том, что дороги не чинят уже много лет.",
    "Мэр обещал, что на ремонт выделят деньги, и что работы начнутся в мае. Но не все поверили, и на встрече было много вопросов о том, кто и когда это сделает.",
)
FINNISH = "Kaupungin keskustassa järjestettiin eilen tapahtuma, johon osallistui satoja ihmisiä eri puolilta maata. Tapahtuman järjestäjät olivat iloisia, ja myös kauppiaat kiittivät."
CHINESE = "昨天晚上，市民们聚集在广场上，讨论新的城市规划。他们认为市中心的树木太少，道路也已经多年没有修理。市长表示，明年五月将开始施工，但是很多人并不相信，会上提出了很多问题。"
STORIES = "<ul>" + "".join(f"<li><a href={i}>Other story {i}</a></li>" for i in range(5)) + "</ul>"
LINES = "\n".join(f"Other story {i}" for i in range(5))


@pytest.mark.parametrize(("body", "expected"), [
    # Languages without listed function words, with and without marks.
    (f"{NAV}<div><p>{RUSSIAN[0]}</p><p>{RUSSIAN[1]}</p></div>{NAV}", "\n".join(RUSSIAN)),
    (f"{NAV}<h1>Otsikko</h1><p>{FINNISH}</p>{NAV}", f"Otsikko\n{FINNISH}"),
    (f"{NAV}<p>{CHINESE}</p>{NAV}", CHINESE),
    (f"<article><p>{CHINESE}</p></article><div>{FINNISH[:60]}</div>", CHINESE),
    # Cards beside the text.
    (f"<div><p>{LONG}</p><p>{LONG}</p></div><article><p>Buy</p></article>", f"{LONG}\n{LONG}"),
    (f"<div><p>{LONG}</p></div><article><h3>Card</h3><p>More</p></article><article><h3>Card</h3><p>More</p></article>", LONG),
    # Lists of links: between the text they stay, after it they go; a single one stays.
    (f"<main><p>{LONG}</p><p>{LONG}</p>{STORIES}</main>", f"{LONG}\n{LONG}"),
    (f"<main>{STORIES}<p>{LONG}</p></main>", LONG),
    (f"<main><p>{LONG}</p>{STORIES}<p>{LONG}</p></main>", f"{LONG}\n{LINES}\n{LONG}"),
    (f"<article><p>{LONG}</p><ul><li><a href=1>Reference</a></li></ul></article>", f"{LONG}\nReference"),
    # The side of `main` beside its article, and the article's heading above it.
    (f"<main><h1>Title</h1><article><p>{LONG}</p></article><div><p>Short side</p></div></main>", f"Title\n{LONG}"),
    # A small article keeps its text against a dense advert that is marked.
    ('<div class="ad">It is the best of all of the things that you could have in this shop.</div><article><p>Small.</p></article>', "Small."),
])
def test_main_text_of_hand_written_pages(body, expected):
    assert main_text.main_text(f"<html><body>{body}</body></html>") == expected


def test_main_text_odd_pages(spark):
    pages = [None, "", "plain", "<p", "<!-- open", "<script>x", "<p>" + "a " * 100_000, "&amp;&#x41;&bogus;", "<a href='>" * 50]
    df = spark.createDataFrame([(i, None, p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    found = {r.page_id: r.text for r in main_text.extracted(df).collect()}
    assert found[0] == found[1] == "" and found[2] == "plain" and found[7].startswith("&A")
    assert len(found) == len(pages)
    assert main_text.extracted(df.limit(0)).count() == 0


def test_given_pages_hold_their_article(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for row in QUERIES["op2_main_text"](spark, sf).collect():
        assert row.n_chars == len(row.text)
        assert "©" not in row.text and row.text.split("\n")[0][:20] in pages[row.page_id].replace("&amp;", "&")


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    known = stages["language_id"](spark, docs, sf)
    assert known.columns == docs.columns
    rows = [tuple(r) for r in known.collect()]
    lines = {d: t for d, _, _, t in brute.site_lines([(r[0], r[3], r[1]) for r in rows])}
    groups = brute.near_duplicates(list(lines.items()), 5, 80)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [(d, t) for d, t in lines.items() if groups[d][2]]
    clean = {d for d, *_, bad in brute.contamination(left, items) if not bad}
    found = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(found) == clean
    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    assert all(found[d] == library.encode(lines[d]) for d in clean)


def test_pipeline_stages_keep_columns_and_take_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (2, "the of and in it " * 30, "en", "s", 1), (2, "the of and in it " * 30, "en", "s", 1)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf)
            assert out.columns == table.columns
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, table, sf).count() == table.count()
    assert F.col("x") is not None
