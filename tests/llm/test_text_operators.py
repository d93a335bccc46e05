"""Quality, language, pseudo-likelihood and similarity operators on small tables with every awkward row."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from tideline.llm import decontaminate, langid, near_copies, pseudo_lm, quality, simhash
from tideline.plans.keyset import may_hold

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long"
LONG = "alpha beta gamma delta " * 20_000


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [
        (1, "The cat sat on the mat.", "en", "a", 1, 0.5, 1),
        (1, "The cat sat on the mat.", "en", "a", 1, 0.5, 1),
        (2, None, "en", "a", None, None, None),
        (3, "", None, None, 0, None, None),
        (4, "  \n\t ", "de", "b", 4, None, None),
        (None, "words without an id", "en", "b", 4, None, None),
        (None, None, None, None, None, None, None),
        (5, LONG, "en", "b", len(LONG), None, None),
        (6, "12 345 !!", "fr", None, 9, None, None),
        (7, "😀 ñandú \u0000 x" + "y" * 300, "es", "c", 1, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


def brute_fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_fingerprints_are_those_of_every_shingle_of_the_whole_text():
    for text in ("", None, "one", "One two", "a b c d e f g a b c d", LONG, "x" * 5000):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_spark_hashes_a_shingle_alike(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("the cat sat on"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("the cat sat on".encode(), 42)


def test_components_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    wanted = brute_components(prints)
    assert {i: r.component_id for i, r in found.items()} == wanted
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == prints


@pytest.mark.parametrize(("shard", "whole", "depth"), [(4, None, 12), (64, None, 12), (100_000, None, 12), (4, 2, 12), (2, 1, 3), (2, 3, 2)])
def test_links_join_all_pairs_at_any_shard_size(spark, monkeypatch, shard, whole, depth):
    monkeypatch.setattr(simhash, "DEPTH", depth)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    noise = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False))) for b in base for _ in range(4)]
    prints = sorted({int(x) for x in [*base, *noise, 0, 1, 3, 2**63]})
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    links = simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), shard=shard, whole=whole)
    parent = {x: x for x in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in links.collect():
        u, v = r.u & (2**64 - 1), r.v & (2**64 - 1)
        assert (u != v)
        parent[max(root(u), root(v))] = min(root(u), root(v))
    assert {x: root(x) for x in prints} == brute_components({x: x for x in prints})


def test_components_of_awkward_rows(spark, awkward):
    rows = simhash.simhash_components(awkward).collect()
    assert len(rows) == awkward.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in zero) == [(False, 0), (True, 2), (True, 3), (True, 4)]
    assert {r.component_id for r in zero} == {2}
    assert simhash.simhash_components(awkward.limit(0)).count() == 0
    kept = simhash.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 5), (False, 6), (False, 7), (True, 0)]


def test_block_links_join_all_alike_sets():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 60)
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.1, 0.3]), rng.integers(0, 1 << 62, 60), base)) for _ in range(150)]
    sets += [np.unique(rng.integers(0, 1 << 62, int(n))) for n in rng.integers(1, 40, 30)]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    members = [set(s.tolist()) for s in sets]
    for i in range(len(sets)):
        for j in range(i):
            if len(members[i] & members[j]) >= 0.8 * len(members[i] | members[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    wanted = [root(i) for i in range(len(sets))]
    parent = list(range(len(sets)))
    found = near_copies.block_links(np.arange(len(sets)), np.concatenate(sets), np.array([len(s) for s in sets]))
    for u, v in found:
        assert root(u) != root(v)
        parent[max(root(u), root(v))] = min(root(u), root(v))
    assert [root(i) for i in range(len(sets))] == wanted


@pytest.mark.parametrize("tile", [512, 3])
def test_dedup_keeps_one_of_texts_that_share_four_fifths_of_their_shingles(spark, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    rng = np.random.default_rng(4)
    rows, copies, others = [], [], []
    for i in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for k, changed in enumerate(((), (20, 80, 140), (5, 70, 71, 130), range(0, 200, 20))):
            text = " ".join("changed" if at in changed else w for at, w in enumerate(words))
            rows.append((10 * i + k, text))
            (copies if k in (1, 2) else others).append(10 * i + k)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    assert any(bin(simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[i // 10 * 10])).count("1") > simhash.RADIUS for i in copies)
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == sorted(others)


def test_dedup_nominates_by_the_trees(spark, monkeypatch):
    words = [f"w{x}" for x in np.random.default_rng(3).integers(0, 5000, 3000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "quite another text than those two are")], "doc_id long, text string")
    asked, near = [], simhash.near_pairs

    def spy(prints):
        asked.append(([r.fp for r in prints.collect()], [tuple(r) for r in near(prints).collect()]))
        return near(prints)

    monkeypatch.setattr(simhash, "near_pairs", spy)
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == [1, 3]
    (prints, links), wanted = asked[0], [simhash.fingerprint(r.text, near_copies.SHINGLE) for r in docs.collect()]
    assert {x & (2**64 - 1) for x in prints} == set(wanted)
    assert wanted[0] == wanted[1] or {x & (2**64 - 1) for x in links[0]} == set(wanted[:2])


def test_a_key_filter_misses_no_key(spark):
    test = may_hold(spark.range(0, 200_000, 2).select(F.xxhash64("id").alias("key")))
    rows = spark.range(200_000).select("id", test(F.xxhash64("id")).alias("held")).groupBy(F.col("id") % 2, "held").count().collect()
    found = {(r[0], r.held): r["count"] for r in rows}
    assert found[(0, True)] == 100_000 and found.get((1, True), 0) < 2000
    none = may_hold(spark.range(0).select(F.xxhash64("id").alias("key")))
    assert spark.range(9).where(none(F.xxhash64("id"))).count() == 0


def test_forward_algorithm_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "abc", "c", "bc"]
    table = langid.PieceTable(pieces)
    rng = np.random.default_rng(1)
    probs = rng.dirichlet(np.ones(len(pieces)), 2).T
    by = dict(zip(pieces, probs))

    def brute(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for n in range(1, len(word) + 1):
            total += (by.get(word[:n], 0) + (langid.STRAY if n == 1 else 0)) * brute(word[n:])
        return total

    words = ["a", "abc", "abcabc", "cab", "zab", "b" * 9]
    assert np.allclose(langid.word_scores(words, table, probs), [np.log(brute("▁" + w)) for w in words])


def test_expected_counts_follow_the_gradient():
    """The expected use of a piece is its probability times the slope of the log likelihood."""
    pieces = ["▁", "▁a", "a", "b", "ab", "abc", "c", "bc"]
    table, words = langid.PieceTable(pieces), ["abc", "cab", "abab"]
    probs = np.random.default_rng(2).dirichlet(np.ones(len(pieces)))
    counts = langid.expected_counts(words, np.ones(3), table, probs)
    for i in range(len(pieces)):
        up = probs.copy()
        up[i] *= 1 + 1e-6
        slope = (langid.word_scores(words, table, up[:, None]) - langid.word_scores(words, table, probs[:, None])).sum() / 1e-6
        assert counts[i] == pytest.approx(slope, abs=1e-4)


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs, model).join(docs, "doc_id").where(langid.held_out())
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_languages_of_awkward_rows(spark, awkward):
    model = langid.fit(awkward)
    assert model.languages == ["en", "es"] or set(model.languages) <= {"de", "en", "es", "fr"}
    rows = langid.identify(awkward, model).collect()
    assert len(rows) == 10
    assert all((r.lang_pred == "und" and r.score == 0) == (r.doc_id in (2, 3, 4, 6) or (r.doc_id is None and r.score == 0)) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in langid.identify(awkward, langid.fit(awkward.limit(0))).collect()} == {"und"}
    assert langid.identify(awkward.limit(0), model).count() == 0
    assert langid.accepted(awkward, model, 0.5).columns == awkward.columns


def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where(~quality.held_out()))
    found = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out())
    right = found.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.95


def test_quality_of_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (None, 1), (6, None), (99, 0)], "doc_id long, quality int")
    model = quality.fit(awkward, labels)
    rows = quality.score(awkward, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert quality.accepted(awkward, model).columns == awkward.columns
    bare = quality.fit(awkward, labels.limit(0))
    assert {r.score for r in quality.score(awkward, bare).collect()} == {0.5}
    assert quality.score(awkward.limit(0), model).count() == 0


def test_nonnegative_risk_finds_negatives_without_their_labels():
    rng = np.random.default_rng(0)
    positive = np.column_stack([rng.normal(0, 1, (5000, 6)), np.ones(5000)])
    unlabelled = np.column_stack([np.concatenate([rng.normal(0, 1, (6000, 6)), rng.normal(3, 1, (4000, 6))]), np.ones(10_000)])
    metric = np.linalg.inv(unlabelled.T @ unlabelled / 40_000 + 0.1 * np.eye(7))
    sums = lambda w: quality.loss_sums(unlabelled, w, -1)
    first = quality.minimise(positive[::2], sums, 0.5, np.zeros(7), metric, 10)
    counts = [np.bincount(quality.bins_of(z @ first), minlength=quality.BINS) for z in (positive[1::2], unlabelled)]
    prior = quality.class_prior(*counts)
    assert prior == pytest.approx(0.6, abs=0.06)
    out = unlabelled @ quality.minimise(positive, sums, prior, np.zeros(7), metric, 20)
    assert np.mean(out[:6000] > 0) > 0.95 and np.mean(out[6000:] < 0) > 0.95


def plain_features(text):
    data, said = (text or "").encode(), (text or "").split()
    if not data:
        return np.zeros(quality.FEATURES)
    words = said or [""]
    shares = [np.sqrt(data.count(bytes([b])) / len(data)) for b in range(256)]
    same = lambda xs: np.mean([a == b for a, b in zip(xs, xs[1:])]) if len(xs) > 1 else 0
    return np.array([*shares, np.log1p(len(data)), len(data) / len(words), same(data), same(words), len(set(words)) / len(words)])


def test_quality_of_a_whole_table_equals_the_plain_risk(spark, sf):
    """Features row by row, scores as plain sums, and weights where the risk over the whole table is least."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where(~quality.held_out())
    model = quality.fit(docs, known, passes=60)
    rows, positives = docs.collect(), {r.doc_id for r in known.collect() if r.quality == 1}
    x = np.array([plain_features(r.text) for r in rows])
    z = np.column_stack([np.clip((x - model.mean) / model.scale, -5, 5), np.ones(len(x))])
    scores = 1 / (1 + np.exp(-z @ model.weights))
    found = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert max(abs(found[r.doc_id] - s) for r, s in zip(rows, scores)) < 0.02
    pos = np.array([r.doc_id in positives for r in rows])

    def risk(w):
        loss = lambda g: np.mean(np.log1p(np.exp(-g)))
        negatives = loss(-(z @ w)) - model.prior * loss(-(z[pos] @ w))
        return model.prior * loss(z[pos] @ w) + np.log1p(np.exp(quality.BEND * negatives)) / quality.BEND + quality.RIDGE / 2 * (w[:-1] ** 2).sum()

    least = risk(model.weights)
    rng = np.random.default_rng(1)
    for size in (0.01, 0.03, 0.1, 0.3):
        assert all(risk(model.weights + rng.normal(0, size, len(model.weights))) > least - 1e-4 for _ in range(20))
    again = quality.fit(docs.repartition(5), known, passes=10)
    assert np.abs(again.weights - quality.fit(docs.coalesce(1), known, passes=10).weights).max() < 1e-2


def plain_languages(texts, model):
    """Each text's language by the recursion over its words, letter by letter, in logarithms."""
    import regex

    logs = {p: np.log(model.probs[i]) for i, p in enumerate(model.pieces)}
    stray, seen = np.log(langid.STRAY), {}

    def word(w):
        if w not in seen:
            w2 = "▁" + w
            alpha = [np.zeros(len(model.languages))]
            for end in range(1, len(w2) + 1):
                terms = [alpha[end - 1] + stray] + [alpha[s] + logs[w2[s:end]] for s in range(max(0, end - 20), end) if w2[s:end] in logs]
                alpha.append(np.logaddexp.reduce(terms, axis=0))
            seen[w] = alpha[-1]
        return seen[w]

    out = []
    for text in texts:
        words = regex.findall(r"[\p{L}\p{M}]+", (text or "").lower())
        if not regex.search(r"\p{L}", text or ""):
            out.append(("und", 0.0))
            continue
        total = sum(word(w) for w in words) / np.sqrt(len(words))
        share = np.exp(total - np.logaddexp.reduce(total))
        out.append((model.languages[int(share.argmax())], share.max()))
    return out


def test_languages_of_a_whole_table_equal_the_plain_recursion(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    hard = spark.createDataFrame([(-1, "x" * 60 + " und der die das", None), (-2, "\u0301\u0302", None), (-3, "हिन्दी भाषा " * 30, None), (-4, "donaudampfschifffahrtsgesellschaft" * 40, None), (-5, "漢字仮名交じり文" * 50, None), (-6, "1 2", None), (-7, None, None)], docs.schema)
    model = langid.fit(docs.where(~langid.held_out()))
    table = docs.unionByName(hard)
    rows = table.collect()
    found = {r.doc_id: r for r in langid.identify(table, model).collect()}
    for r, (lang, score) in zip(rows, plain_languages([r.text for r in rows], model)):
        assert found[r.doc_id].lang_pred == lang and found[r.doc_id].score == pytest.approx(score, abs=1e-6)


def test_long_words_are_summed_whole():
    pieces = ["▁", "▁a", "a", "b", "ab", "abc", "c", "bc"]
    table = langid.PieceTable(pieces)
    probs = np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 2).T
    words = ["abcab" * n + "z" for n in (1, 3, 7, 8, 9, 40)]
    score = lambda: (langid.word_scores(words, table, probs), langid.expected_counts(words, np.ones(6), table, probs[:, 0]))
    whole = score()
    before, langid.PLAIN = langid.PLAIN, 2
    try:
        logs = score()
    finally:
        langid.PLAIN = before
    assert all(np.allclose(a, b) for a, b in zip(whole, logs))


def test_pseudo_likelihood(spark, awkward):
    rows = {r.doc_id: r for r in pseudo_lm.fit_and_score(awkward.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert [rows[i].n_words for i in (1, 2, 3, 4)] == [6, 0, 0, 0]
    assert rows[2].log_prob == 0 and rows[2].mean_log_prob is None
    assert rows[5].n_words == 80_000 and rows[5].mean_log_prob > rows[1].mean_log_prob
    assert len(pseudo_lm.fit_and_score(awkward).collect()) == 10
    assert pseudo_lm.fit_and_score(awkward.limit(0)).count() == 0


def test_training_raises_the_pseudo_likelihood(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    score = lambda: pseudo_lm.fit_and_score(docs).agg(F.sum("log_prob")).first()[0]
    trained = score()
    monkeypatch.setattr(pseudo_lm, "ROUNDS", 0)
    assert trained > score()


def test_every_word_is_a_training_target_once():
    counts = np.array([1, 0, 3, 40, 2, 1])
    places = [pseudo_lm.masked_places(counts, phase) for phase in range(pseudo_lm.ROUNDS)]
    assert sorted(np.concatenate(places).tolist()) == list(range(counts.sum()))
    apart = [pseudo_lm.masked_places(counts[3:], phase) + counts[:3].sum() for phase in range(pseudo_lm.ROUNDS)]
    assert all(set(a.tolist()) <= set(p.tolist()) for a, p in zip(apart, places))


def test_training_takes_every_word_of_the_corpus(spark, sf, monkeypatch, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")

    def step(self, context, wanted, log=str(tmp_path / "steps")):
        self.examples += len(wanted)
        with open(log, "a") as f:
            f.write(f"{len(wanted)}\n")

    monkeypatch.setattr(pseudo_lm.Trainer, "step", step)
    words = pseudo_lm.fit_and_score(docs).agg(F.sum("n_words")).first()[0]
    assert sum(map(int, (tmp_path / "steps").read_text().split())) == words


def test_word_probabilities_sum_to_one():
    counts = np.array([50.0, 20, 10, 5, 5, 3, 2, 5] + [0.01] * 200 + [4])
    words = [f"w{i}" for i in range(len(counts) - 1)]
    model = pseudo_lm.WindowModel(words, pseudo_lm.classes_of(counts, pseudo_lm.CLASSES), pseudo_lm.start_params(counts))
    context = np.tile([0, 1, 2, 3], (len(counts), 1))
    assert np.exp(pseudo_lm.word_log_probs(model, context, np.arange(len(counts)))).sum() == pytest.approx(1, abs=1e-4)


def test_scores_do_not_depend_on_the_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(pseudo_lm, "SHARD_WORDS", 5000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = ({r.doc_id: r.log_prob for r in pseudo_lm.fit_and_score(d).collect()} for d in (docs.coalesce(1), docs.repartition(9)))
    assert one == pytest.approx(many, rel=1e-4)


def test_pseudo_likelihood_of_a_table_equals_a_plain_network(spark, sf):
    """One shard, trained place by place with loops over all words of a class, then scored the same way."""
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 6").select("doc_id", F.substring("text", 1, 900).alias("text"))
    texts = {r.doc_id: re.findall(r"[^\W_]+", r.text.lower()) for r in docs.collect()}
    all_words = [w for t in texts.values() for w in t]
    counted = sorted({w: all_words.count(w) for w in set(all_words)}.items(), key=lambda x: (-x[1], x[0]))
    vocabulary, counts = [w for w, _ in counted], np.array([float(n) for _, n in counted] + [1.0])
    ids = {w: i for i, w in enumerate(vocabulary)}
    kinds = pseudo_lm.classes_of(counts, pseudo_lm.CLASSES)
    params = [p.astype(float) for p in pseudo_lm.start_params(counts)]
    members = {c: [i for i, k in enumerate(kinds) if k == c] for c in set(kinds)}
    outside = len(vocabulary) + 1
    around = lambda own, i: [own[j] if 0 <= j < len(own) else outside for j in range(i - pseudo_lm.SIDE, i + pseudo_lm.SIDE + 1) if j != i]

    def forward(context, wanted):
        e, w1, b1, w2, b2, w3, b3 = params
        x = np.concatenate([e[c] for c in context])
        h = np.tanh(x @ w1 + b1)
        p = np.exp(h @ w2 + b2)
        own = members[kinds[wanted]]
        q = np.exp([w3[i] @ h + b3[i] for i in own])
        return x, h, p / p.sum(), own, q / q.sum()

    encoded = spark.createDataFrame([(i, [ids[w] for w in t]) for i, t in texts.items()], "doc_id long, ids array<int>")
    order = [r.doc_id for r in encoded.orderBy(F.xxhash64("ids", F.col("doc_id").cast("string"))).collect()]
    for phase in range(pseudo_lm.ROUNDS):
        seen = [np.full_like(p, 1e-3) for p in params]
        places = [(around([ids[w] for w in texts[d]], i), ids[texts[d][i]]) for d in order for i in range(len(texts[d])) if i % pseudo_lm.ROUNDS == phase]
        assert len(places) <= 4096
        grads = [np.zeros_like(p) for p in params]
        for context, wanted in places:
            x, h, p, own, q = forward(context, wanted)
            p[kinds[wanted]] -= 1
            dh = params[3] @ p
            if len(own) > 1:
                q[own.index(wanted)] -= 1
                for i, g in zip(own, q):
                    dh = dh + g * params[5][i]
                    grads[5][i] += g * h
                    grads[6][i] += g
            grads[3] += np.outer(h, p)
            grads[4] += p
            dh = dh * (1 - h * h)
            grads[1] += np.outer(x, dh)
            grads[2] += dh
            for j, c in enumerate(context):
                grads[0][c] += params[1][j * pseudo_lm.WIDTH : (j + 1) * pseudo_lm.WIDTH] @ dh
        for i, g in enumerate(grads):
            g = g / len(places)
            seen[i] += g * g
            params[i] = params[i] - 0.1 * g / np.sqrt(seen[i])
    found = {r.doc_id: r.log_prob for r in pseudo_lm.fit_and_score(docs).collect()}
    for d, words in texts.items():
        own, total = [ids[w] for w in words], 0.0
        for i, wanted in enumerate(own):
            _, _, p, mine, q = forward(around(own, i), wanted)
            total += np.log(p[kinds[wanted]]) + np.log(q[mine.index(wanted)])
        assert found[d] == pytest.approx(total, rel=1e-3)


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + same, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
    return h.max()


def test_alignment_equals_the_plain_recursion():
    rng = np.random.default_rng(3)
    left = [rng.integers(0, 5, rng.integers(3, 14)) for _ in range(60)]
    right = [rng.integers(-1, 5, rng.integers(1, 25)) for _ in range(60)]
    assert list(decontaminate.align(left, right)) == [plain_alignment(a, b) for a, b in zip(left, right)]


def test_leaks_exact_edited_and_none(spark):
    item = "Which of these seven old harbour towns lies closest to the northern lighthouse that burned down in winter"
    words = item.split()
    edited = " ".join("changed" if i % 5 == 4 else w for i, w in enumerate(words))
    gapped = " ".join(w + (" inserted" if i % 6 == 5 else "") for i, w in enumerate(words))
    filler = "some entirely other prose about nothing in particular that goes on for a while "
    docs = spark.createDataFrame(
        [(1, filler + item.upper() + " " + filler), (2, filler + edited), (3, gapped), (4, filler * 3), (5, None), (6, ""), (7, " ".join(words[:5])), (None, item), (8, filler * 3000 + item), (9, item + " " + item)],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(10, item), (11, "not there"), (12, None), (13, ""), (None, "no id at all here"), (10, item)], "item_id long, text string")
    found = decontaminate.find_leaks(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 10), (1, 10), (2, 10), (3, 10), (8, 10), (9, 10), (9, 10)]
    assert all(r.score == 1 for r in found if r.doc_id in (1, 8, 9))
    kept = decontaminate.without_leaks(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7]
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_leaks_of_a_whole_table_equal_those_of_every_pair(spark, sf):
    """Every document against every item, aligned in full, without seeds."""
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    from tideline.llm.text import word_lists
    import pyarrow as pa

    def ids(texts):
        flat, counts = word_lists(pa.array(texts))
        return np.split(np.array([hash(w) for w in flat.to_pylist()]), np.cumsum(counts)[:-1])

    d, b = docs.collect(), bench.collect()
    left, right = ids([r.text for r in b]), ids([r.text for r in d])
    wanted = set()
    for i, row in enumerate(d):
        score = decontaminate.align(left, [right[i]] * len(left))
        wanted |= {(row.doc_id, b[j].item_id) for j in range(len(b)) if score[j] >= decontaminate.THRESHOLD * decontaminate.MATCH * len(left[j])}
    assert found == wanted


def test_a_benchmark_larger_than_a_pass_is_read_in_passes(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = decontaminate.find_leaks(docs, bench).drop("row_key").collect()
    monkeypatch.setattr(decontaminate, "PASS_CHARS", 3000)
    assert sorted(decontaminate.find_leaks(docs, bench).drop("row_key").collect()) == sorted(whole)
    assert isinstance(whole, list) and all(isinstance(r, Row) for r in whole)


def test_short_items_string_ids_and_shared_phrases(spark):
    docs = spark.createDataFrame([(f"d{i}", f"which of the following is {i} and nothing else besides") for i in range(300)] + [("x", "say xyzzy loudly"), ("y", "two words here")], "doc_id string, text string")
    items = [(f"i{i}", "which of the following " + " ".join(f"q{i}w{j}" for j in range(20))) for i in range(200)] + [("short", "xyzzy"), ("pair", "two words")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate.find_leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in found) == [("x", "short", 1.0), ("y", "pair", 1.0)]


def test_common_seeds_meet_no_items():
    import pyarrow as pa

    texts = ["which of the following " + " ".join(f"q{i}w{j}" for j in range(20)) for i in range(50)]
    items = decontaminate.Items.of(pa.array(range(50)), pa.array(texts), 3)
    seen = np.where(np.bincount(np.searchsorted(np.unique(items.keys), items.keys))[np.searchsorted(np.unique(items.keys), items.keys)] > 1, 1000, 0)
    assert len(items.rare(seen).keys) == 0
    assert len(items.rare(np.full(len(items.keys), 10**9)).keys) >= 50 * 20  # a benchmark that all documents share is still found


def test_alignment_of_many_pairs_is_bounded_and_alike():
    rng = np.random.default_rng(8)
    left = [rng.integers(0, 4, rng.integers(1, 9)) for _ in range(40)]
    right = [rng.integers(0, 4, rng.integers(1, 60)) for _ in range(40)]
    assert decontaminate.align_all(left, right, cells=100).tolist() == decontaminate.align(left, right).tolist() == [plain_alignment(a, b) for a, b in zip(left, right)]


def test_a_probe_meets_every_near_point_and_leaves_stay_even_at_a_million():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 1 << 64, 1 << 20, dtype=np.uint64, endpoint=False)
    mask = simhash.rest_of([])
    tree = simhash.grow_tree(points[: simhash.FIT_SAMPLE], mask, 9, seed=0)
    point, leaf, probes = simhash.route(points, tree, mask, 4)
    homes = np.bincount(leaf[~probes], minlength=1 << 10)[1 << 9 :]
    assert homes.sum() == len(points) and homes.max() < 4 * homes.mean()
    near = points[:300] ^ np.uint64(1 << 5 | 1 << 40 | 1 << 63)
    both = np.concatenate([points[:300], near])
    point, leaf, probes = simhash.route(both, tree, mask, 4)
    home = {int(p): int(x) for p, x, v in zip(point, leaf, probes) if not v}
    visits = {(int(p), int(x)) for p, x, v in zip(point, leaf, probes)}
    assert all((i, home[i + 300]) in visits or (i + 300, home[i]) in visits for i in range(300))


def test_ties_and_repeated_rows_share_one_fate(spark):
    text = "ein kurzer text und noch einer the same again"
    docs = spark.createDataFrame([(i % 3, text, "de" if i % 2 else "en") for i in range(12)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len({(r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}) == 1
    scored = quality.score(docs, quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")))).collect()
    assert len({r.score for r in scored}) == 1 and len(scored) == 12
    logs = [r.log_prob for r in pseudo_lm.fit_and_score(docs).collect()]
    assert len(logs) == 12 and logs == pytest.approx([logs[0]] * 12, rel=1e-6)
    bench = spark.createDataFrame([(1, text), (2, text)], "item_id long, text string")
    assert len(decontaminate.find_leaks(docs, bench).collect()) == 24
