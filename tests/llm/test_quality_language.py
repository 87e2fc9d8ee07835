"""Quality signals, fences and language models."""

from collections import Counter

import edge
import numpy as np
import pytest

from cellgrid.llm import langid, quality


def test_signals_of_awkward_texts(docs):
    out = quality.judge(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.columns[-2:] == ["_signals", "_kept"]
    rows = {(r.doc_id, r.source): r for r in out.collect()}
    assert rows[1, "a"]._signals.n_words == 0 and not rows[1, "a"]._kept
    repeated = rows[10, "a"]._signals
    assert (repeated.n_words, repeated.n_dup_lines, repeated.n_repeat_words) == (400, 199, 400)
    assert not rows[10, "a"]._kept
    assert rows[9, None]._signals.n_symbols == 40 * 4


def test_repeat_words_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 40)).tolist()) for _ in range(60)]
    want = []
    for t in texts:
        w = t.split()
        times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        want.append(len({i + k for i in range(len(w) - 2) for k in range(3) if times[tuple(w[i : i + 3])] > 1}))
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r.n for r in quality.with_signals(frame).orderBy("i").selectExpr("signals.n_repeat_words AS n").collect()]
    assert got == want


def test_small_groups_lean_on_their_language_and_outliers_go(spark):
    clean = [(i, edge.prose(120, i, 5000), "en", f"s{i % 150}") for i in range(300)]
    odd = [(1000 + i, " ".join(f"{w}##" for w in edge.prose(120, i, 5000).split()), "en", "s0") for i in range(9)]
    frame = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.keep(frame).collect()}
    assert kept == set(range(300))


def _habit(kind, seed):
    """A text with one habit, which varies a little from text to text."""
    words = edge.prose(120, seed).split()
    some = 30 + seed % 7
    if kind == "symbols":
        words[:some] = [w + "#" for w in words[:some]]
    elif kind == "repeats":
        words[60 : 60 + some // 2] = words[: some // 2]
    elif kind == "capitals":
        words = [w.title() for w in words]
    elif kind == "long":
        words = [w + "mnopqr" for w in words]
    elif kind == "short":
        words = [w[:1] + str(i % 10) for i, w in enumerate(words)]
    elif kind == "dup_lines":
        return "\n".join(f"{a} {b} {c}\nagain" for a, b, c in zip(words[::3], words[1::3], words[2::3]))
    return " ".join(words)


HABITS = ("symbols", "repeats", "capitals", "dup_lines", "long", "short")


def test_the_same_text_is_kept_where_it_is_habit_and_rejected_where_it_is_not(spark):
    kinds = ("plain", *HABITS)
    rows = [(-1, _habit(k, 1000 * n + i), "en", k) for n, k in enumerate(kinds) for i in range(120)]
    for n, k in enumerate(HABITS):
        rows += [(n, _habit(k, 77), "en", k), (n, _habit(k, 77), "en", "plain")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = quality.judge(frame).where("doc_id >= 0").collect()
    assert {(HABITS[r.doc_id], r.source): r.kept for r in judged} == {
        pair: pair[1] != "plain" for k in HABITS for pair in ((k, k), (k, "plain"))
    }


def test_fences_against_plain_python(spark):
    rng = np.random.default_rng(5)
    rows = [("en", f"s{i % 3}", *rng.geometric(0.02, len(quality.SIGNALS)).tolist()) for i in range(400)]
    rows += [("de", None, *(9000 + i for _ in quality.SIGNALS)) for i in range(5)]
    frame = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{s} long" for s in quality.SIGNALS))
    got = {(r.lang, r.source): r.asDict() for r in quality.fences(quality.sketches(frame)).collect()}

    def cut(v):
        drop = max(v.bit_length() - 6, 0)
        return v >> drop << drop

    for at, signal in enumerate(quality.SIGNALS):
        cells = Counter((r[0], r[1], cut(r[2 + at])) for r in rows)
        for lang, source in got:
            weights = Counter()
            for test, scale in (
                (lambda a, b: (a, b) == (lang, source), None),
                (lambda a, b: a == lang, quality.WEIGHT),
                (lambda a, b: True, quality.WEIGHT),
            ):
                part = Counter()
                for (a, b, v), n in cells.items():
                    part[v] += n * test(a, b)
                total = sum(part.values())
                weights.update({v: n * 1000 if scale is None else n * scale * 1000 // total for v, n in part.items()})
            total = sum(weights.values())

            def quantile(times, of):
                upto = 0
                for v in sorted(weights):
                    upto += weights[v]
                    if upto * of >= total * times:
                        return v

            def fence(levels):
                near, far = levels[0], None
                for d in levels[1:]:
                    if d > quality.REACH * max(near, quality.UNIT):
                        far = d
                        break
                    near = d
                if far is None:
                    return quality.REACH * max(near, quality.UNIT)
                return max(quality.REACH * near, int((max(near, quality.UNIT) * far) ** 0.5))

            mid = quantile(1, 2)
            steps = range(2, quality.LEVELS + 1)
            found = got[lang, source]
            assert found[f"{signal}_high"] == mid + fence([quantile(2**k - 1, 2**k) - mid for k in steps])
            if signal in quality.TWO_SIDED:
                assert found[f"{signal}_low"] == mid - fence([mid - quantile(1, 2**k) for k in steps])


def test_no_documents(no_docs):
    assert quality.judge(no_docs).count() == 0
    assert langid.keep(no_docs).columns == no_docs.columns and langid.keep(no_docs).count() == 0


@pytest.fixture(scope="module")
def languages(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k, (lang, syllables) in enumerate({"aa": "ba ko ti ru".split(), "bb": "schl wer und ein".split()}.items()):
        for i in range(150):
            words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(30)]
            rows.append((1000 * k + i, " ".join(words), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_rejection(spark, languages):
    identifier = langid.fit(languages.where(~langid.held_out()))
    got = langid.identify(languages.where(langid.held_out()), identifier, ["doc_id", "lang"]).collect()
    assert len(got) > 50
    assert all(r.language.lang == r.lang and 0.5 < r.language.score <= 1 and not r.language.rejected for r in got)
    langs, scores, _, rejected = identifier.predict(["xq zv jj", None, "123 !", "x" * 1_200_000, ""])
    assert langs[1] == langs[2] == langs[4] == "und" and scores[1] == 0
    assert rejected[0] and rejected[3]


def test_model_is_a_distribution(languages):
    model = langid.fit(languages).model
    context = langid.normalised("bako")[:3]
    alphabet = sorted({c for r in languages.collect() for c in langid.normalised(r.text).tolist()} | {32})
    grams = np.array([[*context, c] for c in alphabet], np.int64)
    total = np.exp(model.log_probabilities(grams)).sum(axis=0)
    assert (total < 1.0001).all() and total[model.langs.index("aa")] > 0.97


def test_every_labelled_text_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [letters[i // 676] + letters[i // 26 % 26] + letters[i % 26] + "q" for i in range(3600)]
    rows = spark.createDataFrame([(i, w, "aa") for i, w in enumerate(words)], "doc_id long, text string, lang string")
    model = langid.fit(rows).model
    grams = np.array([langid.normalised(w) for w in words], np.int64)
    assert (model.tables[langid.ORDER - 1].find(model._hash(grams, langid.ORDER)) >= 0).all()


def test_awkward_texts(docs):
    identifier = langid.fit(docs)
    got = langid.identify(docs, identifier, docs.columns)
    assert got.columns == [*docs.columns, "_language"]
    assert got.count() == len(edge.rows())
