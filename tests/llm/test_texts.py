"""Near-duplicates, HTML, token store, token counts and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import html_extract, near_dedup, token_count, token_store
from glyphmill.llm.common import plain, scratch
from tests.conftest import DATA
from tests.llm.conftest import words


def bag(text: str | None) -> Counter:
    w = [x for x in map(plain, (text or "").split()) if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(texts: list[str | None]) -> list[int]:
    """Least member of each text's class, from all pairs."""
    bags = [bag(t) for t in texts]
    above = list(range(len(texts)))

    def top(i: int) -> int:
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            union = sum((bags[i] | bags[j]).values())
            if union and sum((bags[i] & bags[j]).values()) >= 0.8 * union:
                a, b = top(i), top(j)
                above[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def near_copies(seed: int, groups: int, size: int, edits: int) -> list[str]:
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = words(rng, 150, 5000).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("small", "tile", "elements", "salts"), [(16, 512, 4_000_000, 64), (1, 8, 4_000_000, 2), (1, 512, 300, 3)])
def test_classes_equal_all_pairs(table_of, monkeypatch, small, tile, elements, salts):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "TILE_ELEMENTS", elements)
    monkeypatch.setattr(near_dedup, "SALTS", salts)
    monkeypatch.setattr(near_dedup, "FEW", 0 if salts < 64 else near_dedup.FEW)
    rng = random.Random(3)
    texts = near_copies(1, 8, 4, 2) + near_copies(2, 1, 60, 7) + [words(rng, 150, 5000) for _ in range(40)] + ["again and again and again and again " * k for k in (3, 4, 20, 21, 22)]
    texts += texts[:5] + ["one two", "ONE two!", None, "", "..."]
    rng.shuffle(texts)
    got = {r.doc_id: r for r in near_dedup.classes(table_of([(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    want = brute_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    size = Counter(want)
    assert all(r.class_size == size[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_tiles_are_bounded_by_elements(spark, monkeypatch):
    """Long texts of one bucket go to more tiles; a hot centre's pairs go to several tasks."""
    monkeypatch.setattr(near_dedup, "TILE_ELEMENTS", 1000)
    rng = np.random.default_rng(2)
    sets = [np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64)) for _ in range(12)]
    sets[7] = np.sort(np.concatenate([sets[3][:390], sets[7][:10]]))
    els = spark.createDataFrame([(i, x.tobytes(), len(x)) for i, x in enumerate(sets)], "v long, els binary, size long")
    left = spark.createDataFrame([(1, i, i, 12) for i in range(12)], "key long, v long, root long, n long")
    assert [(r.a, r.b) for r in near_dedup._tiled(left, els, 0.8).collect()] in ([(3, 7)], [(7, 3)])
    monkeypatch.setattr(near_dedup, "SALTS", 4)
    monkeypatch.setattr(near_dedup, "FEW", 0)
    pairs = spark.createDataFrame([(3, i) for i in range(12) if i != 3] * 2, "a long, b long")
    assert {(r.a, r.b) for r in near_dedup.verified(pairs, els, 0.8).collect()} == {(3, 7)}
    plan = near_dedup.verified(pairs, els, 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(1)
    base = words(rng, 300).split() + ["x", "y", "z", "u", "v"] * 30
    for edits in (1, 5, 12):
        other = list(base)
        for _ in range(edits):
            other[rng.randrange(300)] = f"q{rng.randrange(99)}"
        other = other[: len(other) - 5 * edits]
        texts = [" ".join(base), " ".join(other)]
        of, h, count = near_dedup.multisets(pa.array(texts), near_dedup._memo())
        s = near_dedup.bag_minhash(of, h, count, 2, 4000)
        x, y = map(bag, texts)
        assert abs((s[0] == s[1]).mean() - sum((x & y).values()) / sum((x | y).values())) < 0.03


def test_near_dedup_odd_rows(odd, odd_rows, empty):
    got = near_dedup.classes(odd).collect()
    assert len(got) == len(odd_rows)
    assert sorted(r.class_size for r in got if r.class_id is None or r.class_id == 5).count(4) == 4
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - 3
    assert near_dedup.classes(empty).count() == near_dedup.keep_one(empty).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><p>The site of the day and the name of it for you and me is here to be seen by all of us</p></header><nav><ul><li><a href=x>Home</a></li><li>Menu</li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make the site better for you and for all of the people who are here with us today.</p></div>
<article><header><h1>A title</h1></header><p>The first paragraph &amp; all of the words that are in it, which is long enough to be the text of a page.<p>Short.</p>
<p>It is   the <b>second</b> one, and it has the words that a text of this kind would have in it.</p></article>
<aside>The other things that are to be read on this site by you and by all of the others who come here.</aside>
<section id="comments"><p>I think that this is the best of the texts that I have read on the site, and it is not even long.</p></section>
<form><p>Your name and the mail that you have, so that we can write to you and to all of the others</p></form><footer>&copy; me</footer></body></html>"""


def test_html_keeps_the_article_alone():
    assert html_extract.main_text(PAGE).split("\n") == [
        "A title",
        "The first paragraph & all of the words that are in it, which is long enough to be the text of a page.",
        "Short.",
        "It is the second one, and it has the words that a text of this kind would have in it.",
    ]


FIRST = "The first paragraph and all of the words that are in it, which is long enough to be the text of a page."
SECOND = "It is the second one, and it has the words that a text of this kind would have in it."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><p>{'İ' * 30}</p><script>var a=1</script><p>{FIRST}</p><p>{SECOND}</p></body>",
        f"<article><p title=don't>{FIRST}</p><p>{SECOND}</p></article>",
        f"<article><p title = 'a > b' data-x=\"it's\">{FIRST}</p><p>{SECOND}</p></article>",
        f"<div class='content no-sidebar'><p>{FIRST}</p><p>{SECOND}</p></div>",
        f"<body class=has-sidebar><div class='header-image share-enabled'><p>{FIRST}</p><p>{SECOND}</p></div></body>",
        f"<div class='menu widget'><p>{FIRST}</p><p>{SECOND}</p></div>",
        f"<article><p title='the hidden truth'>{FIRST}</p><p alt='display: none'>{SECOND}</p></article>",
    ],
)
def test_html_keeps_text_whatever_the_attributes(page):
    got = html_extract.main_text(page).split("\n")
    assert got[-2:] == [FIRST, SECOND]


@pytest.mark.parametrize("attributes", ["hidden", "style='color:red; display : none'", "aria-hidden=true", "class='site-footer'", "id=cookie-notice", "class='x comment-list'", "role=navigation"])
def test_html_drops_what_attributes_mark(attributes):
    page = f"<body><article><p>{FIRST}</p></article><div {attributes}><p>{SECOND}</p></div></body>"
    assert html_extract.main_text(page) == FIRST


@given(st.dictionaries(st.sampled_from(["title", "data-a", "alt", "lang", "onclick"]), st.text(alphabet="ab '=-/;:&", max_size=12), max_size=3), st.sampled_from(["double", "single"]))
@settings(max_examples=150, deadline=None)
def test_html_attributes_never_change_the_text(attributes, quote):
    q = '"' if quote == "double" else "'"
    raw = " ".join(f"{k}={q}{v.replace(q, '')}{q}" for k, v in attributes.items())
    assert html_extract.main_text(f"<article><p {raw}>{FIRST}</p><p>{SECOND}</p></article>").split("\n") == [FIRST, SECOND]


def test_html_other_columns_are_ignored(table_of):
    df = table_of([(1, "u", f"<p>{FIRST}</p>", "kept out", 5)], "page_id long, url string, html string, text string, n_chars long")
    assert [r.text for r in html_extract.extract(df).collect()] == [FIRST]


def test_html_of_the_test_pages(spark):
    import html as entities
    import re

    for r in html_extract.extract(spark.read.parquet(f"{DATA}/pages.parquet")).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = [" ".join(entities.unescape(re.sub(r"<[^>]*>?", "", x)).split()) for x in re.split(r"</?(?:h1|p)>|<br>", inner)]
        assert r.text.replace("\n", " ") == " ".join(x for x in want if x) and r.n_chars == len(r.text)


@given(st.text(alphabet="<>/abp &;=\"'!-\n", max_size=80))
@settings(max_examples=200, deadline=None)
def test_html_never_fails(page):
    html_extract.main_text(page)


def test_html_odd_rows(spark, table_of):
    pages = [(1, None, None), (2, "u", ""), (None, "u", PAGE), (3, "u", "<p>" * 5000), (3, "u", "<p>" * 5000), (4, "u", "<script>never ends"), (5, "u", "plain text without a tag")]
    got = html_extract.extract(table_of(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(table_of([], "page_id long, url string, html string")).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_store.default_vocabulary())


PIECES = token_store._Pieces(token_store.default_vocabulary(), 50)
UNCHANGED = Tokenizer.from_file(token_store.default_vocabulary())


def test_special_tokens_as_the_library_reads_them(tokenizer):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "a <|endoftext| > b"]
    ids, starts = token_store.encode_array(pa.array(texts), PIECES)
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert 50256 in ids


def test_ids_of_many_rows_are_dealt_to_several_files(spark, table_of):
    rng = random.Random(21)
    data = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, words(rng, 30), None, None) for i in range(900)]
    df = table_of(data)
    path = scratch(spark, "test")
    token_store.write(df, path, file_bytes=sum(len(d[1]) for d in data) // 12)
    store = token_store.read(spark, path)
    files = Counter((r.part, r.doc_id) for r in store.select("part", "doc_id").collect())
    for hot in (None, 7):
        sizes = [n for (_, i), n in files.items() if i == hot]
        assert len(sizes) >= 3 and max(sizes) < 150
    got = sorted(token_store.digests(store).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and len(got) == 900
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))


@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "a ", " b", "c", "\n"]), max_size=6).map("".join) | st.text(alphabet=st.sampled_from(list("ab'sZé中 \n\t.,-12  ​\x85\x1c<|>")), max_size=40), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_encoding_equals_the_library(texts):
    ids, starts = token_store.encode_array(pa.array(texts), PIECES)
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == UNCHANGED.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_store_round_trip(spark, tokenizer, odd, odd_rows, encoding):
    path = scratch(spark, "test")
    token_store.write(odd, path, file_bytes=60_000, encoding=encoding)
    got = token_store.digests(token_store.read(spark, path)).collect()
    want = sorted(((r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in odd_rows), key=lambda x: (x[0] is not None, x[0] or 0))
    key = lambda i, n, c: (-1 if i is None else i, n, c)
    assert sorted(key(r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(key(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    # starts follow the order of ids, each where the one before ends
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [i for i, _ in want]
    assert {r.doc_id for r in token_store.read(spark, path, 3, 6).collect()} == {3, 4, 5, 6}
    files = sorted(f.path for f in __import__("os").scandir(path.removeprefix("file://")) if f.name.endswith(".parquet"))
    column = pq.ParquetFile(files[-1]).metadata.row_group(0).column(4)
    assert any("DICTIONARY" in e for e in column.encodings) == (encoding == "dictionary") and column.has_column_index


def test_token_store_of_an_empty_table(spark, empty):
    assert token_store.store_and_digest(empty).count() == 0


def test_counts_equal_the_tokenizer(spark, table_of):
    pieces = token_count.vocabulary(token_count.default_vocabulary())
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *pieces], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_count.SPACE, prepend_scheme="always", split=True)
    texts = ["", " ", "a", "  two  spaces ", "a▁b", "中文 字\nx", "💩 <unk> <0x41>", "1" * 60, *[r.text[:400] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()]]
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(table_of([(i, x, None, None) for i, x in enumerate(texts)])).collect()}
    assert got == {i: len(t.encode(x).ids) for i, x in enumerate(texts)}


def test_counts_of_odd_rows(odd, odd_rows, empty):
    got = token_count.count_tokens(odd).collect()
    assert len(got) == len(odd_rows) and {r.n_tokens for r in got if r.doc_id in (0, 1)} == {0}
    assert token_count.count_tokens(empty).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from glyphmill.llm import decontam, mixing, toxicity

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    labels, items = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, DATA).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.score(before, toxicity.fit(before, labels)).collect()}
            assert {r.doc_id for r in after.collect()} == {i for i, s in scores.items() if s < 0.5}
        if name == "near_dedup":
            rows_ = before.orderBy("doc_id").collect()
            assert after.count() == len(set(brute_classes([r.text for r in rows_])))
        if name == "decontaminate":
            bad = {r.doc_id for r in decontam.matches(before, items).collect()}
            assert bad and {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
        if name == "mix":
            copies = Counter(r.doc_id for r in after.collect())
            assert all(copies[r.doc_id] * r.size == r.taken for r in mixing.mixture(before).collect())
        if name == "tokens":
            # the ids themselves, against the library
            want = sorted((r.doc_id, [*UNCHANGED.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in before.collect())
            assert sorted((r.doc_id, list(r.ids)) for r in after.collect()) == want and after.where("size(ids) <> n_tokens").count() == 0
        else:
            assert after.columns == columns
        before = after


def test_run_leaves_only_results(spark, tmp_path):
    """All stages in one call give what they give one by one, and their own tables are gone."""
    import os

    import corpus_pipeline
    from glyphmill.llm.common import root, rooted

    def digest(df):
        return sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in df.collect())

    with rooted(spark, f"file://{tmp_path}/run"):
        got = digest(corpus_pipeline.run(spark, DATA))
        left = {p.rsplit("-", 1)[0] for p in os.listdir(root(spark).removeprefix("file://"))}
    assert left == {"stage-toxicity", "stage-near_dedup", "stage-decontaminate", "stage-mix", "tokens"}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert got and got == digest(corpus_pipeline.STAGES[-1][1](spark, docs, DATA))


def test_scratch_without_a_named_folder(spark, monkeypatch):
    """A stock session names no folder: one is made once, and the setting stays as it is."""
    from glyphmill.llm import common

    class Bare:
        sparkContext = spark.sparkContext

        class conf:
            get = staticmethod(lambda key, default=None: default)

    monkeypatch.setattr(common, "_ROOTS", {})
    first, second = common.scratch(Bare, "a"), common.scratch(Bare, "b")
    assert first.startswith("file://") and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_stages_on_odd_rows(spark, odd, empty, table_of, tmp_path):
    import corpus_pipeline

    table_of([(5, 1), (7, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table_of([(1, "other text of the same id")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, str(tmp_path)).count() >= 0


@pytest.mark.parametrize("stage", ["classes", "keep_one", "remove", "mix"])
def test_row_numbers_hold_when_the_second_scan_is_split_otherwise(spark, table_of, monkeypatch, stage):
    """Between the passes the files become one split instead of several, as when executors come or go."""
    from glyphmill.llm import decontam, mixing, near_dedup

    rng = random.Random(9)
    text = lambda: " ".join(f"t{rng.randrange(10**6)}" for _ in range(40))
    docs = [(i, text(), None, f"s{i % 2}") for i in range(60)]
    docs += [(100 + i, docs[i][1] + " more", None, "s0") for i in range(0, 60, 7)]
    items = [(i, docs[i][1]) for i in range(0, 60, 9)]
    df, marks = table_of(docs, parts=6), table_of(items, "item_id long, text string")
    setting = "spark.sql.files.minPartitionNum"

    def result():
        if stage == "classes":
            return sorted((r.doc_id, r.class_id, r.class_size) for r in near_dedup.classes(df).collect())
        if stage == "keep_one":
            return sorted(r.doc_id for r in near_dedup.keep_one(df).collect())
        if stage == "remove":
            return sorted(r.doc_id for r in decontam.remove(df, marks).collect())
        return sorted(r.doc_id for r in mixing.mix(df).collect())

    spark.conf.set(setting, "64")
    try:
        want = result()
        module, last = {"classes": (near_dedup, "signatures"), "keep_one": (near_dedup, "copies"), "remove": (decontam, "contaminated"), "mix": (mixing, "sizes")}[stage]
        whole = module.materialise

        def cut(frame, name, *path):
            out = whole(frame, name, *path)
            if name == last:
                spark.conf.set(setting, "1")
            return out

        monkeypatch.setattr(module, "materialise", cut)
        assert result() == want
        if stage == "classes":
            assert sum(size == 2 for _, _, size in want) == 18
    finally:
        spark.conf.unset(setting)


def test_counts_of_whole_and_very_long_texts_equal_the_tokenizer(spark, table_of):
    pieces = token_count.vocabulary(token_count.default_vocabulary())
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *pieces], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_count.SPACE, prepend_scheme="always", split=True)
    longest = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").selectExpr("text", "length(text) AS n").orderBy("n", ascending=False).limit(60).collect()]
    texts = [*longest, " ".join(longest) + "\n 中文 💩" * 500]
    assert len(texts[-1]) > 100_000
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(table_of([(i, x, None, None) for i, x in enumerate(texts)])).collect()}
    assert got == {i: len(t.encode(x).ids) for i, x in enumerate(texts)}


PROSE = "This is what the paragraph of the article has to say, and it is long enough to be the text of a page that is read by the people who want it. " * 2


@pytest.mark.parametrize("piece", ["<img src='x.png'>", "<svg><path d='M0'/></svg>", "<math><mi>x</mi></math>", "<select><option>a</select>", "<script>var a = 1;</script>", "<button>press</button>", "<wbr>", "<!-- note -->"])
def test_unseen_pieces_inside_a_paragraph_leave_it_whole(piece):
    """Only block-level tags end a block."""
    page = f"<body><p>{PROSE} one{piece}two {PROSE}</p></body>"
    assert html_extract.main_text(page) == " ".join(f"{PROSE} onetwo {PROSE}".split())


def test_unknown_elements_inside_a_paragraph():
    page = f"<body><p>{PROSE} <my-x class='note'>three <b>four</b></my-x> {PROSE}</p><my-ad class='advert'>{PROSE}</my-ad></body>"
    assert html_extract.main_text(page) == " ".join(f"{PROSE} three four {PROSE}".split())


def test_marks_inside_an_article():
    """A dense block wins over a name that merely holds a mark; whole marks, and what is short or full of links, stay out."""
    whole = PROSE.strip()
    page = f"""<article><div class="post-header"><h1>What it says</h1></div><section id="social-history"><p>{PROSE}</p></section><div class="share-price">{PROSE}</div><p>{PROSE}</p>
      <div class="share-buttons">Share this</div><div class="related-posts"><h3>More</h3><a href=a>the one and the other</a><a href=b>and the next one of it</a></div>
      <div class="newsletter-signup">{PROSE}</div><div class="sidebar">{PROSE}</div></article><div class="share-price">{PROSE}</div>"""
    assert html_extract.main_text(page).split("\n") == ["What it says", whole, whole, whole]


def test_pages_in_languages_without_stop_words():
    text = "这是一个中文页面的正文内容我们需要保留它。" * 6
    page = f"<body><div class=menu>菜单 首页</div><ul><li><a href=x>链接一</a></li></ul><div><p>{text}</p><p>{text}</p></div><footer>版权所有</footer></body>"
    assert html_extract.main_text(page) == f"{text}\n{text}"
    finnish = "Tämä teksti kertoo pitkästi siitä, miten sivun varsinainen sisältö pitää säilyttää kokonaisena eikä hukata matkalla. " * 3
    assert html_extract.main_text(f"<body><nav>Etusivu</nav><p>{finnish}</p><p>{finnish}</p></body>") == "\n".join([finnish.strip()] * 2)


def test_broken_markup_takes_time_in_proportion():
    import time

    began = time.time()
    assert html_extract.main_text("<div>" * 100_000 + "</x>" * 100_000 + "</span></q>" * 50_000 + f"<p>{PROSE}</p>" + "</p>" * 100_000) == PROSE.strip()
    assert time.time() - began < 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<b>", "</b>", "<a href=x>", "</a>", "<img src=y>", "<my-x>", "</my-x>", "<br-x/>", "<svg></svg>", "<i class=ad>", "</i>", "</q>", "<!-- c -->", "<input>"]), max_size=12), st.randoms(use_true_random=False))
def test_inline_tags_never_cut_a_paragraph(tags, rng):
    words = (PROSE + PROSE).split()
    out = list(words)
    for tag in tags:
        at = rng.randrange(len(out))
        out[at] += tag if not tag.startswith("<a ") else tag + "</a>"
    assert html_extract.main_text("<body><p>" + " ".join(out) + "</p></body>") == " ".join(words)
