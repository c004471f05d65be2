"""Toxicity, language and importance models: held-out accuracy, parts by hand, odd rows."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tablewright.llm import importance, language_id, substring_dedup, toxicity
from tablewright.llm.common import held_out


def test_held_out_fifth(spark):
    got = {r[0]: r[1] for r in spark.range(200).select("id", held_out(F.col("id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


# toxicity


def marks(text):
    grammar = toxicity.Grammar(toxicity.NEGATION_SCOPE, toxicity.REPORT_SCOPE, toxicity.TARGET_SCOPE, toxicity.THREAT_SCOPE)
    state, out = grammar.start, []
    for token in toxicity.TOKENS.findall(text.lower()):
        symbol = toxicity.BREAK if token in ',;:()"' else toxicity.FIXED.get(token, toxicity.INSULT if token in toxicity.INSULTS else toxicity.OTHER)
        state, m = grammar.step(state, symbol)
        if m:
            out.append((token, m))
    return out


def test_composed_marks():
    assert marks("you utter idiot") == [("idiot", toxicity.TARGETED)]
    assert marks("you are not an idiot") == [("idiot", toxicity.TARGETED | toxicity.NEGATED)]
    assert marks("not today, idiot") == [("idiot", 0)] or marks("not today, idiot") == []
    assert marks("she said he is an idiot") == [("idiot", toxicity.REPORTED | toxicity.TARGETED)]
    assert marks("i will hurt you") == [("you", toxicity.THREATENED)]


def test_clauses_soften_and_add():
    scorer = toxicity.Scorer(toxicity.start_lexicon(), toxicity.START_COEFFICIENTS)
    plain, direct, denied = (scorer.score(t) for t in ("the weather is fine", "you pathetic idiot, you scum", "you are not an idiot"))
    assert plain < denied < direct and direct > 0.5 > plain
    assert scorer.score("idiotic clownfish") == plain or scorer.score("clownfish") == plain
    assert scorer.score("") == plain and 0 <= plain <= 1


def test_learned_words_and_stems_hold_out(spark, prose):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.2
        words = prose(3_000 + i, 60).split(" ")
        if toxic:
            words.insert(rng.randint(0, 50), rng.choice(["zzblark", "qqfoo" + rng.choice("abcdefgh") * 3]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marked = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, marked)
    assert "zzblark" in model[0].words or any("zzblark".startswith(s) for s in model[0].stems)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    wrong = [i for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0 and got[i] != y]
    assert not wrong
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, p in got.items() if not p}


def test_odd_rows_of_toxicity(spark, odd, none, odd_rows):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(odd, labels)
    scored = toxicity.score(odd, model)
    assert scored.count() == len(odd_rows) and scored.columns.count("score") == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored.collect())
    one_kind = spark.createDataFrame([(5, 0), (11, 0)], "doc_id bigint, toxic int")
    assert toxicity.fit(odd, one_kind)[1] == toxicity.START_COEFFICIENTS
    assert toxicity.score(none, model).count() == 0 and toxicity.drop_toxic(odd, model).columns == odd.columns


# languages


def sentence(rng, alphabet, n):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_languages_hold_out(spark):
    rng = random.Random(22)
    kinds = {"aa": "aeioustrn", "bb": "aeioußkwz", "cc": "àéèoçstrn"}
    rows = [(i, sentence(rng, kinds[k], rng.randint(3, 40)), k) for i, k in enumerate(rng.choice(list(kinds)) for _ in range(600))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(df, rows=300)
    assert model.languages == sorted(kinds) and 0 < (model.weights != 0).mean() < 0.2
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df.drop("lang"), model).collect()}
    out = [(got[i][0] == k, got[i][1]) for i, _, k in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([ok for ok, _ in out])
    assert right > 0.97 and abs(np.mean([s for _, s in out]) - right) < 0.1


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 300)
    logits = 8 * (np.eye(3)[y] + rng.normal(0, 0.7, (300, 3)))

    def loss(t):
        return -np.log(language_id.softmax(logits / t)[np.arange(300), y]).mean()

    t = language_id.fit_temperature(logits, y)
    assert t > 1 and all(loss(t) <= loss(x) + 1e-6 for x in (0.5, 1, 2, 4, 8, 16))


def test_odd_rows_of_languages(odd, none, odd_rows):
    model = language_id.fit(odd)
    got = language_id.predict(odd, model)
    rows = got.collect()
    assert len(rows) == len(odd_rows) and got.columns.count("lang_pred") == 1
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if not any(c.isalpha() for c in r.text or ""))
    assert all(r.lang_pred in model.languages for r in rows if any(c.isalpha() for c in r.text or ""))
    empty = language_id.fit(none)
    assert {r.lang_pred for r in language_id.predict(odd, empty).collect()} == {"und"} and language_id.predict(none, model).count() == 0


# importance


def test_kth_largest_is_exact(spark):
    rng = random.Random(23)
    for values in ([rng.gauss(0, 100) for _ in range(3_000)], [float(rng.randint(0, 9)) for _ in range(500)], [1.0] * 50, [-1e300, 0.0, 1e-300, 5.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        for k in {1, len(values) // 3, len(values) - 1}:
            assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1] if k else True
        assert importance.kth_largest(df, "x", len(values)) == -math.inf


def test_resample_prefers_the_target(spark, prose):
    rng = random.Random(24)
    rows = [(i, prose(5_000 + i, 60) if i % 2 else " ".join(rng.choice("zq xj kv".split()) + "###" for _ in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    target = spark.createDataFrame([(i,) for i in range(1, 100, 2)], "doc_id bigint")
    got = importance.resample(docs, target, share=0.5).collect()
    assert sum(r.kept for r in got) == 150 and sum(r.kept and r.doc_id % 2 for r in got) >= 145
    assert sorted(got) == sorted(importance.resample(docs.repartition(7), target, share=0.5).collect())


def test_log_weights_by_hand(spark):
    texts = ["a b a", "b b. c", "", None]
    df = spark.createDataFrame([(i, t, i == 0) for i, t in enumerate(texts)], "doc_id bigint, text string, good boolean")
    wanted, every = importance.count_models(df, "text", "good")
    assert wanted.sum() == 5 and every.sum() == 5 + 7
    ratio = importance.log_ratio(wanted, every)
    got = {r.doc_id: r.log_weight for r in importance.with_log_weight(df, ratio).collect()}
    assert got[2] == got[3] == 0 and got[0] > got[1]


def test_odd_rows_of_importance(spark, odd, none, odd_rows):
    target = spark.createDataFrame([(5,), (None,), (5,)], "doc_id bigint")
    got = importance.resample(odd, target, share=1.0)
    assert got.count() == len(odd_rows) and got.where("kept").count() == len(odd_rows)
    uniform = importance.resample(odd, target.limit(0), share=0.5).collect()
    assert {r.log_weight for r in uniform} == {0.0} and 0 < sum(r.kept for r in uniform) < len(odd_rows)
    assert importance.resample(none, target).count() == 0


# substring dedup


def repeats_by_hand(rows, n):
    seen = defaultdict(set)
    for k, t in rows:
        w = (t or "").lower().split()
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])].add(k)
    return {k for v in seen.values() if len(v) > 1 for k in v}


def test_repeated_passages_wherever_they_stand(spark, prose):
    passages = [prose(6_000 + i, 56).replace("\n", " ") for i in range(12)]
    rows = [(i, " ".join([prose(6_100 + i, 5 + i % 40), passages[i % 12], prose(6_400 + i, 7 + i % 31)])) for i in range(48)]
    rows += [(100 + i, prose(6_800 + i, 150)) for i in range(60)] + [(200 + i, prose(6_900, 20) + " " + prose(7_000 + i, 40)) for i in range(20)]
    spans = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    got = spans.collect()
    found = {r.doc_id for r in got}
    want = repeats_by_hand(rows, 51)
    assert len(want & found) >= 0.9 * len(want) and found <= repeats_by_hand(rows, 25)
    assert all(r.removed == (r.first_doc != r.doc_id) for r in got)
    cleaned = {r.doc_id: r.text for r in substring_dedup.without_spans(spark.createDataFrame(rows, "doc_id bigint, text string"), spans).collect()}
    texts = dict(rows)
    for k in found:
        gone = {w for r in got if r.doc_id == k and r.removed for w in range(r.first_word, r.first_word + r.n_words)}
        assert cleaned[k].split() == [w for i, w in enumerate(texts[k].split()) if i not in gone]


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = substring_dedup.tuned(threshold, 0.95)
        assert 1 - (1 - threshold**rows) ** bands >= 0.95 and bands * rows <= 8


def test_near_paragraphs_are_verified(spark, prose, monkeypatch):
    """Small edits at a paragraph's end keep it above the threshold; a paragraph apart stays out."""
    monkeypatch.setattr(substring_dedup, "REACH", 40)
    base = prose(7_100, 60).replace("\n", " ")
    rows = [(1, base), (2, base + " more"), (3, prose(7_101, 60).replace("\n", " "))]
    got = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2} and Counter(r.removed for r in got) in ({True: 1, False: 1}, {True: 2, False: 2})


def test_later_copies_go_where_an_edited_one_comes_first(spark, prose):
    """The first copy is edited, so the second holds first occurrences beside later ones; only the first stay."""
    words = [prose(7_200 + g, 300).split() for g in range(4)]
    rows = []
    for g, w in enumerate(words):
        edited = w[:110] + prose(7_250 + g, 80).split() + w[190:]
        rows += [(10 * g, " ".join(edited))] + [(10 * g + k, " ".join(w)) for k in range(1, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    spans = substring_dedup.repeated_spans(docs)
    kept = {r.doc_id: len(r.text.split()) for r in substring_dedup.without_spans(docs, spans).collect()}
    for g in range(4):
        assert kept[10 * g] == 300 and 80 <= kept[10 * g + 1] < 220
        assert [kept[10 * g + k] for k in range(2, 6)] == [0] * 4
    rows = spans.collect()
    assert all(r.removed == (r.first_doc != r.doc_id) for r in rows) and {r.removed for r in rows if r.doc_id == 1} == {True, False}


def test_near_paragraphs_of_one_inner_edit(spark, prose):
    """Lines of 60 to 100 words in texts of their own, one word changed in the middle: all are found."""
    rows, pairs = [], 24
    for i in range(pairs):
        line = prose(7_300 + i, 60 + i % 5 * 10).split()
        edited = line[: len(line) // 2] + ["edited"] + line[len(line) // 2 + 1 :]
        rows += [(2 * i + k, "\n".join([prose(7_400 + 2 * i + k, 30).replace("\n", " "), " ".join(w), prose(7_500 + 2 * i + k, 40)])) for k, w in enumerate((line, edited))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    spans = substring_dedup.repeated_spans(docs).collect()
    whole = {r.doc_id for r in spans if r.removed and r.first_doc == r.doc_id - 1 and r.n_words >= 60 + r.doc_id // 2 % 5 * 10}
    assert len(whole) >= 0.9 * pairs and all(k % 2 for k in whole)


def test_paragraphs_are_lines_or_cuts_of_long_ones(prose):
    short, long, endless = "few words here", prose(7_600, 60).replace("\n", " "), prose(7_601, 900).replace("\n", " ")
    texts = [f"{short}\n{short}\n{long}\n{short}\n \n{short}\n".encode(), None, endless.encode()]
    (_, words, row, _, start), = substring_dedup.cut_texts(texts)
    assert [s for s in start if row[s] == 0] == [0, 6, 66, 69]
    sizes = np.diff(np.r_[[s for s in start if row[s] == 2], len(words)])
    assert len(sizes) >= 5 and sizes[:-1].min() > 40 and sizes.sum() == 900


def test_equal_sets_of_any_length_meet(spark):
    """A phrase of five words said six or twelve times has the same shingles."""
    rows = [(1, "alpha beta gamma delta epsilon " * 6), (2, "alpha beta gamma delta epsilon " * 12)]
    got = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.removed for r in got} == {1: False, 2: True}


def test_odd_rows_of_spans(odd, none):
    got = substring_dedup.repeated_spans(odd)
    rows = got.collect()
    assert {r.doc_id for r in rows} == {5, 6, 11} and substring_dedup.repeated_spans(none).count() == 0
    assert substring_dedup.without_spans(odd, got).count() == odd.count()


def roots_of(links):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in list(root)}


def near_by_hand(texts, pieces):
    """All pairs of distinct contents at 0.8 or more, through lists of the sets that hold a shingle."""
    sets, holders = {}, defaultdict(list)
    for own, hashed, found, at in substring_dedup.units([t.encode() for t in texts], 25, pieces):
        for i, h in enumerate(substring_dedup.signed(hashed).tolist()):
            sets[h] = frozenset(found[at == i].tolist())
    links = set()
    for h, mine in sets.items():
        shared = Counter(o for x in mine for o in holders[x])
        links |= {(o, h) for o, n in shared.items() if n >= 0.8 * (len(mine) + len(sets[o]) - n)}
        for x in mine:
            holders[x].append(h)
    return links


def templated(prose, groups=12, members=8, share=0.7):
    """Groups of near paragraphs, all filled into one template of ``share`` of their words."""
    template, rng, out = prose(7_700, 80).split(), random.Random(77), []
    slots = rng.sample(range(80), int(80 * (1 - share)))
    for g in range(groups):
        own = dict(zip(slots, prose(7_710 + g, len(slots)).split()))
        base = [own.get(i, w) for i, w in enumerate(template)]
        out += [" ".join([*base[: 80 - m % 4], *(f"tail{g}x{m}x{i}" for i in range(m % 3))]) for m in range(members)]
    return out


@pytest.mark.parametrize("pieces", [True, False])
@pytest.mark.parametrize("block", [500, 3])
def test_buckets_lose_no_links(spark, prose, monkeypatch, pieces, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    texts = templated(prose) + templated(prose, groups=30, members=3, share=0.85) + [prose(7_800 + i, 90) for i in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    banding = substring_dedup.tuned(0.8, 0.95, substring_dedup.PIECE_HASHES if pieces else substring_dedup.MOST_HASHES)
    classes = substring_dedup.classes_of(rows, "text", "doc_id", banding, 0.8, 25, pieces)
    met, sets = substring_dedup.colliding(rows, "text", "doc_id", classes, banding[0], 25, pieces)
    got = roots_of((r.a, r.b) for r in substring_dedup.near_links(met, sets, 0.8).collect())
    want = near_by_hand(texts, pieces)
    assert len(want) > 30 and sum(got.get(a, a) == got.get(b, b) for a, b in want) >= 0.95 * len(want)
    groups = defaultdict(list)
    for x, top in roots_of(want).items():
        groups[top].append(x)
    pairs = [(a, b) for g in groups.values() for i, a in enumerate(g) for b in g[:i]]
    assert sum(got.get(a, a) == got.get(b, b) for a, b in pairs) >= 0.9 * len(pairs)
    exact = roots_of(want)
    assert all(exact.get(x) == exact.get(top) for x, top in got.items())


def test_joining_links_leave_out_what_is_joined():
    sets = [np.arange(k, k + 20, dtype=np.int64) for k in (0, 1, 2, 100, 101, 300)]
    roots = np.arange(6, dtype=np.int64)
    assert len(substring_dedup.joining_links(sets, roots, np.zeros(6, int), 0.8)) == 3
    assert substring_dedup.joining_links(sets, np.array([0, 0, 0, 3, 4, 5]), np.zeros(6, int), 0.8) == [(3, 4)]
    assert substring_dedup.joining_links(sets, roots, np.array([0, 1, 1, 0, 0, 1]), 0.8) == [(0, 1), (0, 2)]


def test_texts_of_one_id_are_told_apart_and_lines_stay(spark, prose):
    shared, own = prose(7_900, 120), "own line one\nown  line two\n\n" + prose(7_901, 90)
    docs = spark.createDataFrame([(1, shared), (2, shared), (2, own), (3, "\n own line one\n\n" + shared)], "doc_id bigint, text string")
    spans = substring_dedup.repeated_spans(docs)
    kept = sorted((r.doc_id, r.text) for r in substring_dedup.without_spans(docs, spans).collect())
    assert (1, shared) in kept and (2, "") in kept and (2, own) in kept
    assert next(t for k, t in kept if k == 3).startswith("\n own line one\n\n")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 12])
def test_few_words_make_paragraphs(n):
    words = np.arange(1, n + 1, dtype=np.uint64)
    start, end = substring_dedup.paragraphs(words, np.zeros(n, np.int64))
    assert [k for a, b in zip(start, end, strict=True) for k in range(a, b)] == list(range(n))


def test_sieve_keeps_all_it_holds_and_little_else(spark):
    hashes = np.random.default_rng(3).integers(-(2**63), 2**63, 40_000)
    rows = spark.createDataFrame([(int(h),) for h in hashes[:10_000]], "h bigint")
    words = substring_dedup.sieve(rows, F.col("h"), 10_000).value
    kept = substring_dedup.passes(words, hashes.view(np.uint64))
    assert kept[:10_000].all() and kept[10_000:].mean() < 0.05
    none = substring_dedup.sieve(rows.limit(0), F.col("h"), 0).value
    assert not substring_dedup.passes(none, hashes.view(np.uint64)).any()


def test_shuffled_joins_give_the_same_and_move_no_texts(spark, prose, monkeypatch):
    texts = templated(prose, groups=6, members=4) + [prose(8_000 + i, 60) + " " + prose(8_100, 70) for i in range(5)] + [prose(8_200, 90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want = sorted(map(tuple, substring_dedup.repeated_spans(docs).collect()))
    plans, cut = [], substring_dedup.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().split("\n"))
        return cut(df)

    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(substring_dedup, "cut", seen)
    assert sorted(map(tuple, substring_dedup.repeated_spans(docs).collect())) == want and want
    under = [plan[i:] for plan in plans for i, line in enumerate(plan) if " AS _text_in" in line]
    assert under
    for first, *rest in under:
        depth = len(first) - len(first.lstrip(" :+-"))
        inside = itertools.takewhile(lambda line: len(line) - len(line.lstrip(" :+-")) > depth, rest)
        assert not any("Join" in line for line in inside)


def test_repeated_shingles_count_once():
    rng = np.random.default_rng(5)
    size = np.array([3, 5, 40, 7, 12])
    words = rng.integers(1, 4, size.sum()).astype(np.uint64)
    found, at = substring_dedup.paragraph_shingles(words, size)
    every, of = substring_dedup.shingles(words, np.repeat(np.arange(5), size))
    assert len(found) < len(every) and (np.diff(at) >= 0).all()
    assert all(sorted(found[at == i].tolist()) == sorted(set(every[of == i].tolist())) for i in range(5))


@pytest.mark.parametrize("cells", [0, 1 << 20])
def test_blocks_are_joined_as_by_hand(monkeypatch, cells):
    monkeypatch.setattr(substring_dedup, "TABLE_CELLS", cells)
    rng = np.random.default_rng(9)
    sets = [np.flatnonzero(rng.random(40) < 0.85).astype(np.int64) + 1_000 * (i % 3) for i in range(60)]
    roots, side = np.arange(60) // 2, rng.integers(0, 2, 60)
    got = roots_of([*substring_dedup.joining_links(sets, roots, side, 0.8), *[(int(r), int(r)) for r in roots]])
    shared = {(i, j): len(set(sets[i]) & set(sets[j])) for i in range(60) for j in range(i) if side[i] != side[j]}
    near = [(int(roots[i]), int(roots[j])) for (i, j), n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
    assert len(near) > 10 and roots_of([*near, *[(int(r), int(r)) for r in roots]]) == got
