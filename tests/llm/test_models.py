"""Language ID, toxicity and language-model scores: held-out accuracy and odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import langid, lm_score, toxicity
from glyphmill.llm.common import Memo


def crc(i: int) -> int:
    return zlib.crc32(str(i).encode())


@pytest.fixture
def languages():
    rng = random.Random(4)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "ich"], "cc": ["eau", "oux", "tre", "ill"]}
    word = lambda p: "".join(rng.choice(p) for _ in range(rng.randrange(1, 5)))
    return [(i, " ".join(word(p) for _ in range(12)), lang, None) for i in range(600) for lang, p in [list(parts.items())[i % 3]]]


def test_language_id_on_held_out_rows(table_of, languages):
    df = table_of(languages)
    got = langid.predict(df, langid.fit(df)).collect()
    truth = {d[0]: d[2] for d in languages}
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98


def test_unseen_words_back_off_to_ngrams(table_of, languages):
    df = table_of(languages)
    model = langid.fit(df)
    new = langid.predict(table_of([(1, "kalomikalomikalo", None, None), (2, "schungeinichungsch", None, None), (3, "12 !!", None, None)]), model).collect()
    assert {r.doc_id: r.lang_pred for r in new} == {1: "aa", 2: "bb", 3: "und"}


def test_language_id_ignores_held_out_labels(table_of, languages):
    spoiled = [(i, t, "zz" if crc(i) % 4 == 2 else lang, s) for i, t, lang, s in languages]
    assert "zz" not in langid.fit(table_of(spoiled)).langs


def test_language_id_odd_rows(odd, odd_rows, empty):
    model = langid.fit(odd)
    got = langid.predict(odd, model).collect()
    assert len(got) == len(odd_rows)
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2, 10)} == {"und"}
    assert langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"}


@pytest.fixture
def insults():
    rng = random.Random(6)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(clean) for _ in range(rng.randrange(20, 60))]
        if i % 6 == 0:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), "zork" + rng.choice(["", "er", "ing", "o", "ul"]) + rng.choice(clean)[:1])
        docs.append((i, " ".join(w), None, None))
        labels.append((i, int(i % 6 == 0)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark, table_of, insults):
    docs, labels = insults
    df, marks = table_of(docs), table_of(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, marks)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [(got[i], t) for i, t in labels if crc(i) % 5 == 0]
    assert np.mean([(s >= 0.5) == (t == 1) for s, t in held]) > 0.95
    left = toxicity.keep_clean(df, model)
    assert left.columns == df.columns and left.count() == sum(s < 0.5 for s in got.values())


def test_misspellings_share_ngrams(insults):
    docs, labels = insults
    model = toxicity.train(pa.array([d[1] for d in docs]), np.array([t for _, t in labels]))
    p = toxicity.word_projection(model, ["zorkerly", "xzork", "abcde"])[:, 0]
    assert p[0] > p[2] and p[1] > p[2]


def test_toxicity_odd_rows(odd, odd_rows, empty, table_of):
    none = table_of([], "doc_id long, toxic int")
    some = table_of([(5, 1), (5, 0), (3, None), (None, 1), (7, 0), (8, 0)], "doc_id long, toxic int")
    for marks in (none, some):
        model = toxicity.fit(odd, marks)
        got = toxicity.score(odd, model).collect()
        assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
        assert toxicity.keep_clean(odd, model, threshold=1.1).count() == len(odd_rows)
        assert toxicity.score(empty, model).count() == 0
    assert {r.score for r in toxicity.score(odd, toxicity.fit(empty, none)).collect()} == {0.5}


def test_memo_is_bounded_and_right():
    memo = Memo(lambda t: np.array([len(x) for x in t]), limit=5)
    for words in (["a", "bb"], ["ccc", "a", "dddd", "e" * 9, "f"], ["g" * 7, "bb", "f"], []):
        assert memo(words).tolist() == [len(w) for w in words]
    assert len(memo.ids) <= 5


def test_language_model(table_of):
    rng = random.Random(8)
    follows = {f"v{k}": [f"v{(3 * k + j) % 40}" for j in range(2)] for k in range(40)}

    def text(n: int) -> list[str]:
        w = ["v0"]
        while len(w) < n:
            w.append(rng.choice(follows[w[-1]]))
        return w

    docs = [text(120) for _ in range(1500)]
    df = table_of([(i, " ".join(w), None, None) for i, w in enumerate(docs)])
    model = lm_score.fit(df)
    mixed = [list(w) for w in docs[:100]]
    for w in mixed:
        rng.shuffle(w)
    probe = table_of([(i, " ".join(w), None, None) for i, w in enumerate(docs[:100])] + [(1000 + i, " ".join(w), None, None) for i, w in enumerate(mixed)])
    got = {r.doc_id: r for r in lm_score.score(probe, model).collect()}
    assert sum(got[i].score > got[1000 + i].score for i in range(100)) > 95
    assert all(r.n_tokens == 120 and abs(r.log_prob / 120 - r.score) < 1e-9 for r in got.values())


def test_probabilities_sum_to_one():
    p = lm_score.start(np.random.default_rng(0).integers(1, 50, lm_score.SYMBOLS).astype(float))
    near = np.full((len(lm_score.OFFSETS), lm_score.SYMBOLS), 3)
    assert abs(np.exp(lm_score.log_probs(p, near, np.arange(lm_score.SYMBOLS))).sum() - 1) < 1e-3


def test_gradient_lowers_the_loss():
    p = lm_score.start(np.ones(lm_score.SYMBOLS))
    rng = np.random.default_rng(1)
    s = rng.integers(0, 20, 4000)
    near = lm_score.windows(np.repeat(s, 2), np.zeros(8000, int))
    before = lm_score.log_probs(p, near, np.repeat(s, 2)).mean()
    for _ in range(20):
        lm_score.step(p, near, np.repeat(s, 2), np.arange(8000), 3.0)
    assert lm_score.log_probs(p, near, np.repeat(s, 2)).mean() > before + 1


def test_language_model_odd_rows(odd, odd_rows, empty):
    model = lm_score.fit(odd)
    got = lm_score.score(odd, model).collect()
    assert len(got) == len(odd_rows)
    assert all((r.n_tokens == 0 and r.score == 0) if r.doc_id in (0, 1, 2, 10) else r.n_tokens > 0 for r in got if r.doc_id is not None)
    assert lm_score.score(empty, lm_score.fit(empty)).count() == 0
    assert lm_score.score(odd, lm_score.fit(empty)).count() == len(odd_rows)


def test_rare_words_are_predicted(spark, table_of, monkeypatch):
    """Within a symbol, counted words score by their counts and others by their characters, wherever values are held."""
    common = [f"c{i}" for i in range(lm_score.FREQUENT)]
    # of the words that end alike and share a symbol, one is eight times as frequent
    docs = [(i, " ".join(common[i::10] * 12), None, None) for i in range(10)] + [(10 + i, "oftenzz c1 " * 8 + "seldomzz c2", None, None) for i in range(1)]
    df = table_of(docs)
    probe = table_of([(1, "oftenzz", None, None), (2, "seldomzz", None, None), (3, "neverseenqqxjwzz", None, None)])
    seen = []
    for held in (200_000, 1, 0):
        monkeypatch.setattr(lm_score, "HELD", held)
        model = lm_score.fit(df)
        got = {r.doc_id: r.score for r in lm_score.score(probe, model).collect()}
        assert abs(got[1] - got[2] - np.log(8)) < 1e-6 and got[3] < got[2] - 5
        seen.append(got)
    assert all(abs(x[i] - seen[0][i]) < 1e-3 for x in seen for i in x)


def test_training_sees_every_position(odd):
    model = lm_score.fit(odd)
    assert model.seen == sum(r.n_tokens for r in lm_score.score(odd, model).collect()) > 60_000


def test_rare_insults_keep_their_weight():
    """A word of four toxic texts among 1,000 is far under any share of the sample, and is learned all the same."""
    rng = random.Random(3)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    texts, toxic = [], np.zeros(1000, int)
    for i in range(1000):
        toxic[i] = i % 5 == 0
        texts.append(" ".join([*rng.choices(clean, k=30), *(["qwyxvut"] if i in (0, 250, 500, 750) else ["zorkus"] if toxic[i] else [])]))
    model = toxicity.train(pa.array(texts), toxic)
    assert toxicity.word_projection(model, ["qwyxvut"])[0, 0] > 1


TEXTS = ["ka lo mitu, KA sch! ung", "kalomi schungein zzz 12 !!", "eaux", None, "", "... 12", "ka " * 50 + "eau"]


def test_language_scores_equal_a_loop(table_of, languages):
    """Word by word and n-gram by n-gram, from the fitted tables alone."""
    model = langid.fit(table_of(languages))
    k = len(model.langs)

    def found(order, h):
        at = np.searchsorted(model.hashes[order], h)
        return model.logs[order][at] if at < len(model.hashes[order]) and model.hashes[order][at] == h else None

    def word(w):
        row = found(0, langid.word_hash([w])[0])
        for order in langid.ORDERS:
            if row is not None:
                return row
            known = [x for x in (found(order, h) for h in langid.grams([w], order)[1]) if x is not None]
            row = sum(known) / len(known) if known else None
        return np.zeros(k) if row is None else row

    got = {r.doc_id: r for r in langid.predict(table_of([(i, t, None, None) for i, t in enumerate(TEXTS)]), model).collect()}
    for i, text in enumerate(TEXTS):
        words = [w for w in map(langid.plain, (text or "").split()) if any(c.isalpha() for c in w)]
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        total = sum(word(w) for w in words)
        assert got[i].lang_pred == model.langs[int(np.argmax(total))] and abs(got[i].score - 1 / np.exp(total - total.max()).sum()) < 1e-9


def test_ties_go_to_the_first_language(table_of):
    model = langid.Model(["aa", "bb"], {0: langid.word_hash(["same"])}, {0: np.full((1, 2), -3.0)}, "tie")
    got = [(r.lang_pred, r.score) for r in langid.predict(table_of([(1, "same SAME", None, None), (2, "ЖЖЖ", None, None)]), model).collect()]
    assert got == [("aa", 0.5), ("aa", 0.5)]


def test_toxicity_scores_equal_a_loop(table_of, insults):
    """Each word's mean over its rows, each text's damped mean over its words."""
    docs, labels = insults
    model = toxicity.train(pa.array([d[1] for d in docs]), np.array([t for _, t in labels]))
    texts = [*[d[1] for d in docs[:12]], *TEXTS]
    got = {r.doc_id: r.score for r in toxicity.score(table_of([(i, t, None, None) for i, t in enumerate(texts)]), model).collect()}
    for i, text in enumerate(texts):
        times = {}
        for w in map(toxicity.plain, (text or "").split()):
            if w:
                times[w] = times.get(w, 0) + 1
        top = bottom = 0.0
        for w, n in times.items():
            weight = 1 + toxicity.POWER * np.log(n)
            top += weight * float(np.mean([model.projection[b] for b in toxicity.features([w])[1]]))
            bottom += weight
        assert abs(got[i] - 1 / (1 + np.exp(-(top / (toxicity.NEUTRAL + bottom) + model.bias)))) < 1e-6


def test_toxicity_training_is_bounded_and_reruns_alike(table_of, insults, monkeypatch):
    docs, labels = insults
    df, marks = table_of([*docs, (901, "zork " * 5000, None, None)]), table_of([*labels, (901, 0)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 3_000_000)
    one, two = toxicity.fit(df, marks), toxicity.fit(df.repartition(7), marks)
    assert (one.projection == two.projection).all() and one.bias == two.bias
    # the budget is filled in the order of a hash, by whole texts; a repeated text counts once
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 40_000)
    few, _ = toxicity._training_rows(df.unionAll(df), marks, "doc_id", "text", 1000)
    size = {r.toxic: (r.n, r.b) for r in few.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()}
    assert all(1 <= n and b <= 20_000 for n, b in size.values()) and few.count() == few.distinct().count()
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 10)
    assert toxicity._training_rows(df, marks, "doc_id", "text", 1000)[0].count() == 2


@pytest.mark.parametrize("length", [600, 15_000])
def test_long_texts_teach_toxicity(table_of, length):
    """Texts of some 4 kB and of 90 kB teach alike."""
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice([f"w{rng.randrange(400)}", f"zorku{rng.randrange(9)}"] if i % 2 and k % 20 == 0 else [f"w{rng.randrange(400)}"]) for k in range(length)), None, None) for i in range(60)]
    labels = table_of([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    df = table_of(docs)
    scores = {r.doc_id: r.score for r in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    assert all((s >= 0.5) == (i % 2 == 1) for i, s in scores.items())


@pytest.mark.parametrize("length", [500, 4_000])
def test_long_texts_teach_languages(table_of, length):
    """Texts of 4 kB and of 25 kB teach alike; words of one language alone decide."""
    rng = random.Random(4)
    words_of = {"de": [f"das{rng.randrange(300)}haus" for _ in range(200)], "en": [f"the{rng.randrange(300)}house" for _ in range(200)]}
    docs = [(i, " ".join(rng.choice(words_of["de" if i % 2 else "en"]) for _ in range(length)), "de" if i % 2 else "en", None) for i in range(40)]
    df = table_of(docs)
    got = langid.predict(df, langid.fit(df)).collect()
    assert all(r.lang_pred == ("de" if r.doc_id % 2 else "en") and r.score > 0.9 for r in got)


def test_language_tables_are_bounded(table_of, languages, monkeypatch):
    """Of more words than a table holds the most frequent stay, and the rest still backs off."""
    df = table_of(languages)
    whole = langid.fit(df)
    monkeypatch.setattr(langid, "WORDS", 60)
    monkeypatch.setattr(langid, "CELLS", 40 * len(whole.langs))
    small = langid.fit(df)
    assert all(0 < len(h) <= 60 for h in small.hashes.values()) and set(small.hashes) == {0, *langid.ORDERS}
    assert set(small.hashes[0]) <= set(whole.hashes[0]) or len(small.hashes[0]) < len(whole.hashes[0])
    monkeypatch.setattr(langid, "LANGS", 1)
    assert len(langid.fit(df).langs) == 1


def test_words_of_one_frequency_are_bounded_too(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("word"), F.lit(3).cast("long").alias("c0"))
    assert 300 < langid._frequent(rows, F.col("c0"), 500).count() < 700
    mixed = rows.unionAll(spark.range(100).select(F.concat(F.lit("x"), "id"), F.lit(90).cast("long")))
    assert langid._frequent(mixed, F.col("c0"), 500).where("c0 = 90").count() == langid._frequent(mixed, F.col("c0"), 500).count() == 100


def test_language_model_scores_equal_a_loop(table_of):
    """Every position by itself: neighbours' vectors, class, word in the class, and word in the symbol."""
    rng = random.Random(31)
    docs = [(i, " ".join(f"v{rng.randrange(30)}" for _ in range(40)), None, None) for i in range(60)]
    model = lm_score.fit(table_of(docs))
    texts = [docs[0][1], "v1 v2 never v3", "v1", "never", "", None]
    got = {r.doc_id: r for r in lm_score.score(table_of([(i, t, None, None) for i, t in enumerate(texts)]), model).collect()}
    p = {k: v.astype(np.float64) for k, v in model.params.items()}
    for i, text in enumerate(texts):
        words = (text or "").split()
        s = lm_score.symbol_of(model.symbols, words)
        total = 0.0
        for at, symbol in enumerate(s):
            h = p["hidden"] + sum(p["embed"][k][s[at + d] if 0 <= at + d < len(s) else lm_score.SYMBOLS] for k, d in enumerate(lm_score.OFFSETS))
            h = np.tanh(h)
            c = symbol // lm_score.IN_CLASS
            x, y = np.append(h, 1) @ p["cls"], np.append(h, 1) @ p["word"][c]
            total += x[c] - np.log(np.exp(x).sum()) + y[symbol % lm_score.IN_CLASS] - np.log(np.exp(y).sum())
            total += float(model.within.tokens(model.symbols, [words[at]])["log_p"][0])
        assert got[i].n_tokens == len(words) and abs(got[i].log_prob - total) < 1e-3 * max(1, len(words))


def test_encoded_texts_score_like_texts(table_of):
    docs = [(i, f"a{i % 7} b{i % 5} c{i % 3} d only{i}", None, None) for i in range(120)]
    df = table_of(docs)
    model = lm_score.fit(df)
    by = lambda frame: sorted((r.doc_id, r.n_tokens, round(r.log_prob, 6)) for r in frame.collect())
    assert by(lm_score.score(df, model)) == by(lm_score.scored(model.encoded, model)) == by(lm_score.fit_and_score(df))


def test_language_model_reruns_alike(table_of):
    docs = [(i, f"a{i % 7} b{i % 5} c{i % 3} d", None, None) for i in range(200)]
    df = table_of(docs)
    runs = [sorted((r.doc_id, round(r.log_prob, 6)) for r in lm_score.score(df, lm_score.fit(df)).collect()) for _ in range(2)]
    assert runs[0] == runs[1]
