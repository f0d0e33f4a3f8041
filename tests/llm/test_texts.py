import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import contamination, langid, mixing
from strandmill.llm.wikitext import plain_words, prose_blocks, visible_text, words

PASSAGE = "The census of 1723 counted 8636 people in Walknoin while Belbritalost had lost the annual fair of Skiost and the river valley"


@pytest.mark.parametrize(
    "markup",
    [
        "The [[census|census]] of 1723 counted '''8636''' people in [[Walknoin]], while [[Belbritalost (town)|Belbritalost]] had lost the annual fair of Skiost and the river valley.",
        "The census of 1723<ref>note, 12</ref> counted 8636<!-- check --> people in&nbsp;Walknoin, while<ref name='x' /> Belbritalost{{cn|date=2014}} had lost the annual fair of Skiost and the river valley.",
        "{{quote|The census of 1723 counted 8636 people in Walknoin, while Belbritalost had lost the annual fair of Skiost and the river valley.|someone}}",
        "<blockquote>THE CENSUS of 1723 counted\n8636 people in Walknoin, while  Belbritalost had lost the annual fair of <b>Ski</b>ost and the river valley</blockquote>",
        ": The census of 1723 counted 8636 people in Walknoin, while\n: Belbritalost had lost the annual fair of Skiost and the river valley.",
        "{{Broken|9|67\n\nThe census of 1723 counted 8636 people in Walknoin, while Belbritalost had lost the annual fair of Skiost and the river valley",
        "{{Infobox|a={{x|{{{1|}}}}}\n|b=2}}The census of 1723 counted 8636 people in Walknoin, while Belbritalost had lost the annual fair of Skiost and the river valley",
    ],
)
def test_words_as_seen(markup):
    assert " ".join(plain_words(PASSAGE)) in " ".join(words(markup))


def test_hidden_text():
    assert words("a {{efn|hidden note}} b <!-- c --> d [[Category:E]] <ref>f</ref> <nowiki>[[g]]</nowiki> &eacute;") == ["a", "b", "d", "g", "é"]
    assert words("été") == words("été")
    assert words(None) == words("") == [] and visible_text("x <!-- open") == "x "
    assert words("{| class=\"x\"\n! # !! A\n|-\n| 1 || Briwa\n|}\nend") == ["a", "1", "briwa", "end"]


def test_prose():
    text = "== Head ==\nOne [[two|three]] four.<ref>x</ref>\n{| a\n| cell\n|}\n* [[Only (link)]]\n* [[Link]] and words\n[[Kategorie:X]]\n{{Infobox\n| a = 1\n}}\n"
    assert prose_blocks(text) == ["One three four.", "Link and words"]
    assert prose_blocks("#REDIRECT [[A]]") == prose_blocks(None) == prose_blocks(" ") == []


def leak_rows(spark, docs, items, **params):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, passage string")
    rows = contamination.leaks(d, i, **params).collect()
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    return {(r.doc_id, r.item_id): r for r in rows}


def test_leaks(spark):
    w = PASSAGE.split()
    edited = " ".join(x if k % 10 else "other" for k, x in enumerate(w))
    docs = [(1, "x " * 50 + PASSAGE, ""), (2, " ".join(w[4:16]), ""), (3, " ".join(w[4:15]) + " z", ""), (4, None, ""), (5, "", ""), (6, edited, ""), (7, "nothing here", ""), (8, ("y " * 60_000) + PASSAGE + " q" * 60_000, ""), (1, PASSAGE, "")]
    got = leak_rows(spark, docs, [(10, PASSAGE), (11, PASSAGE), (12, None), (13, "too short")])
    found = {k for k, r in got.items() if r.longest_run >= 12}
    assert found == {(d, i) for d in (1, 2, 8) for i in (10, 11)}
    assert got[(1, 10)].score == 1.0 and got[(6, 10)].score > 0.5 > got[(6, 10)].longest_run / 24
    assert leak_rows(spark, docs, []) == {} and leak_rows(spark, [], [(10, PASSAGE)]) == {}


def test_edited_copy_in_a_large_corpus(spark):
    # 200 documents share every 8-gram that the edited copy has left
    r = np.random.default_rng(6)
    w = [f"p{i}" for i in range(60)]
    parts = [w[a : a + 9] for a in range(0, 60, 10)]
    edited = " ".join(" ".join([*p, "other"]) for p in parts)
    common = [(100 + i, " ".join(" ".join([*parts[k], *r.choice(["u", "v"], 30)]) for k in r.permutation(6)), "") for i in range(200)]
    got = leak_rows(spark, [(1, edited, ""), *common], [(10, " ".join(w))])
    assert got[(1, 10)].score == pytest.approx((2 * 54 - 6) / 120, abs=0.02)
    # the others show runs of nine words out of order, a small part of the passage each
    assert all(got[k].score < 0.3 for k in got if k != (1, 10))


def test_short_runs_and_short_passages(spark):
    w = [f"p{i}" for i in range(60)]
    edited = " ".join(x if k % 7 else "other" for k, x in enumerate(w))
    docs = [(1, "x y " + edited, ""), (2, "a b c d z", ""), (3, "one two three", ""), (4, "p1 p2 p3 p4 z", "")]
    got = leak_rows(spark, docs, [(10, " ".join(w)), (11, "two three"), (12, "a b c d e f")], gram=4)
    assert got[(1, 10)].score > 0.7 and got[(3, 11)].score == 1.0
    assert (4, 10) not in got and got[(2, 12)].score == pytest.approx(8 / 12)
    assert (3, 11) in leak_rows(spark, docs, [(11, "two three")])


def test_recall_of_edited_copies(spark):
    """Copies with words replaced, dropped, added and moved, of which half the score is left."""
    r = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(vocab, int(r.integers(36, 116))))) for i in range(40)]
    docs, truth = [], {}
    for d in range(300):
        i = int(r.integers(0, 40))
        w, rate = items[i][1].split(), float(r.uniform(0.02, 0.18))
        out = []
        for x in w:
            u = r.random()
            out += [] if u < rate / 3 else [str(r.choice(vocab))] if u < 2 * rate / 3 else [x, str(r.choice(vocab))] if u < rate else [x]
        if d % 3 == 0:  # a sentence moved to the front
            k = int(r.integers(5, len(out) - 5))
            out = out[k:] + out[:k]
        docs.append((d, " ".join([*r.choice(vocab, 200), *out, *r.choice(vocab, 200)]), ""))
        score = contamination.align([np.unique([*out, *w], return_inverse=True)[1][: len(out)]], [np.unique([*out, *w], return_inverse=True)[1][len(out) :]])[0][0]
        truth[d, i] = score / (2 * len(w))
    got = leak_rows(spark, docs, items, gram=3, least=0.5)
    want = {k for k, v in truth.items() if v >= 0.5}
    have = {k for k in want if k in got and got[k].score >= 0.5}
    assert len(want) > 200 and len(have) >= 0.95 * len(want)
    # the same documents among others: the rest of the corpus changes nothing
    more = leak_rows(spark, docs + [(1000 + k, t, "") for k, (_, t, _) in enumerate(docs)], items, gram=3, least=0.5)
    assert {k: v.score for k, v in more.items() if k[0] < 1000} == {k: v.score for k, v in got.items()}


def test_long_documents_in_pieces(spark):
    r = np.random.default_rng(3)
    w = [f"p{i}" for i in range(60)]
    filler = [f"f{i}" for i in range(50)]
    for at in (49_950, 50_000, 50_060):
        text = " ".join([*r.choice(filler, at), *w, *r.choice(filler, 60_000)])
        got = leak_rows(spark, [(1, text, "")], [(10, " ".join(w)), (11, " ".join(filler * 2))], gram=4)
        assert got[(1, 10)].score == 1.0 and got[(1, 10)].longest_run == 60


def test_blocks_of_items_agree(spark):
    r = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocab, 30))) for i in range(12)]
    docs = []
    for d in range(60):
        i = int(r.integers(0, 12))
        w = items[i][1].split()
        a, n = int(r.integers(0, 12)), int(r.integers(8, 18))
        docs.append((d, " ".join([*r.choice(vocab, 20), *w[a : a + n], *r.choice(vocab, 20)]), ""))

    def brute(text, passage):
        x, y = text.split(), passage.split()
        s = {tuple(y[j : j + 12]) for j in range(len(y) - 11)}
        return any(tuple(x[j : j + 12]) in s for j in range(len(x) - 11))

    want = {(d, i) for d, t, _ in docs for i, p in items if brute(t, p)}
    for size in (10**6, 70):
        assert {k for k, v in leak_rows(spark, docs, items, block_words=size).items() if v.longest_run >= 12} == want


def test_alignment_against_plain():
    r = np.random.default_rng(2)

    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        return h.max()

    pairs = [(r.integers(0, 5, r.integers(1, 30)).astype(np.int32), r.integers(0, 5, r.integers(1, 20)).astype(np.int32)) for _ in range(40)]
    score, _ = contamination.align([a for a, _ in pairs], [b for _, b in pairs])
    assert score.tolist() == [plain(a, b) for a, b in pairs]


def mix_frames(spark):
    docs = [(i, " A " if i % 4 else "b", "one two three " * (1 + i % 5), "x") for i in range(400)] + [(1000, None, "text", ""), (1001, "other", "text", ""), (1002, "a", None, ""), (1003, "A", "", "")]
    targets = [("a", 0.5, 1), ("B", 0.4, 2), ("c", 0.1, 5)]
    return spark.createDataFrame(docs, "doc_id bigint, source string, text string, rate string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mix(spark):
    docs, targets = mix_frames(spark)
    counts = mixing.token_counts(docs)
    assert {r.id: r.tokens for r in counts.where("id >= 1002").collect()} == {1002: 0, 1003: 0}
    rate = mixing.rates(counts, targets)
    by = {r.source: r for r in rate.collect()}
    total = by["a"].tokens + by["b"].tokens
    assert by["a"].total == total and by["c"].tokens == 0 and by["c"].rate == 0.0
    assert by["a"].rate == pytest.approx(0.5 * total / by["a"].tokens) and by["b"].rate == pytest.approx(min(2, 0.4 * total / by["b"].tokens))
    drawn = mixing.draw(counts, rate)
    assert drawn.collect() == mixing.draw(counts.repartition(3), rate).orderBy("id").collect() or sorted(map(tuple, drawn.collect())) == sorted(map(tuple, mixing.draw(counts.repartition(3), rate).collect()))
    rep = {r.source: r for r in mixing.report(drawn, rate).collect()}
    assert rep["a"].share_reached == pytest.approx(0.5 / 0.9, abs=0.06) and rep["b"].most_copies <= 2
    assert {(r.source, r.holds) for r in mixing.on_target(drawn, rate).collect()} == {(x, True) for x in "abc"}
    mix = mixing.emit(docs, rate)
    assert "BroadcastHashJoin" in mix._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.n) for r in mix.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()} == {(r.id, r.copies) for r in drawn.where("copies > 0").collect()}
    assert mix.count() == sum(r.copies for r in drawn.collect()) and mix.columns == [*docs.columns, "copy_no"]
    assert mixing.report(mixing.draw(counts.limit(0), mixing.rates(counts.limit(0), targets)), mixing.rates(counts.limit(0), targets)).count() == 3


def test_labels():
    for label, want in {"en": "en", "EN ": "en", "en-US": "en", "pt_PT": "pt", "ger": "de", "Polish": "pl", "fi": "other", "la": "other", None: None, "": None, " ": None, "und": None, "??": None, "-": None, "null": None, "n/a": None, "unknown": None}.items():
        assert langid.label_language(label) == want, label


def test_windows_keep_all_words():
    text = "A first sentence. " + "word " * 100 + ". Köln liegt am Rhein! " + "x" * 500 + " ende"
    w = langid.sentence_windows(text)
    assert all(0 < len(x) <= langid.WINDOW for x in w)
    assert b"".join(w).replace(b" ", b"") == text.replace(" ", "").encode()
    assert langid.sentence_windows("é" * 300) and all(x.decode() for x in langid.sentence_windows("é" * 300))


def test_gradients():
    net = langid.ByteNet(1)
    r = np.random.default_rng(1)
    x, y = r.integers(1, 256, (6, langid.WINDOW)).astype(np.uint8), r.integers(0, 10, 6)

    def loss():
        h, _ = net.features(x)
        z = h.astype(np.float64) @ net.p["out"] + net.p["bias"]
        lp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        want = np.full_like(lp, 0.05 / 10)
        want[np.arange(6), y] += 0.95
        return -(want * lp).sum() / 6

    g = net._gradients(x, y)
    for name in net.p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, step = net.p[name][at], np.float32(1e-3)
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 2e-3 == pytest.approx(g[name][at], rel=0.05, abs=1e-4), name


@pytest.fixture(scope="module")
def net(spark):
    return langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"))


def test_held_out_accuracy(spark, net):
    """Evaluation passages are no training text and carry right labels."""
    rows = spark.read.parquet("/root/testdata/sf0.01/eval_items.parquet").select("lang", "passage").collect()
    found = langid.document_stretches(net, [r.passage for r in rows])
    right = sum(langid.CODES[max(f, key=lambda s: s[1])[0]] == r.lang for r, f in zip(rows, found))
    assert right / len(rows) >= 0.97


def test_stretches_and_cases(spark, net):
    rows = spark.read.parquet("/root/testdata/sf0.01/eval_items.parquet").select("lang", "passage").collect()
    text = {}
    for r in rows:
        text.setdefault(r.lang, r.passage)
    docs = [
        (1, "de", text["de"], "x"), (2, None, text["fr"], "x"), (3, "English", text["ru"], "x"), (4, "nl", text["nl"] + "\n\n" + text["pl"] + "\n\n" + text["nl"], "x"),
        (5, "en", None, "x"), (6, "en", "", "x"), (7, None, "too few words", "x"), (8, "fi", text["sv"], "x"), (None, "en", text["en"], "x"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, lang string, text string, words string")
    s = langid.stretches(df, net)
    doc = langid.document_languages(s)
    got = {(r.doc_id, r.kind, r.lang) for r in langid.label_cases(doc).collect()}
    assert got == {(2, "missing", "fr"), (3, "wrong", "ru"), (4, "mixed", "pl"), (8, "wrong", "sv")}
    assert doc.where("confidence between 0.4 and 1").count() == doc.count() == 5
    assert langid.label_cases(langid.document_languages(langid.stretches(df.limit(0), net))).count() == 0


def test_training_without_labels(spark):
    df = spark.createDataFrame([(1, None, "text")], "doc_id bigint, lang string, text string")
    assert langid.fitted(df) is langid.fitted(df)
    assert langid.stretches(df, langid.fitted(df)).count() == 1
