"""Quality, toxicity, languages, mixing and chats against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from diffmill.llm import language_id, mixing, quality_rules, queries, reply_trees, toxicity
from diffmill.llm.batches import learned_from

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
    )


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_quality_counts(request, table):
    frame = request.getfixturevalue(table)
    texts = {r.doc_id: r.text for r in frame.collect()}
    rows = quality_rules.judged(frame).collect()
    assert len(rows) == frame.count()
    for r in rows:
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert found == base_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed) and 0 <= r.quality <= 1


def test_quality_of_no_rows(none):
    assert quality_rules.judged(none).count() == 0


def test_votes_find_accuracies():
    # two good rules and one that votes at random
    patterns = Counter()
    for i in range(4000):
        good = i % 4 != 0
        votes = [1 if (i * k % 10 < 9) == good else -1 for k in (7, 3)]
        patterns[(*votes, 1 if i % 3 else -1)] += 1
    model = quality_rules.estimate(patterns)
    assert model.good[0][1] > 0.8 and model.bad[0][-1] > 0.7
    assert abs(model.good[2][1] - model.bad[2][1]) < 0.1
    assert quality_rules.posterior(model.logit((1, 1, -1))) > 0.9 > 0.1 > quality_rules.posterior(model.logit((-1, -1, 1)))
    assert model.logit((0, 0, 0)) == pytest.approx(model.logit((1, 1, 1)) - model.logit((1, 1, 1)) + model.logit((0, 0, 0)))


def test_posterior_equals_plain_python(docs):
    """Expectation-maximisation over the documents one by one instead of the histogram."""
    chosen = quality_rules.rules()
    rows = quality_rules.judged(docs).select("quality", *[r.vote().alias(r.name) for r in chosen]).collect()
    votes = [tuple(r[k.name] for k in chosen) for r in rows]
    model = quality_rules.estimate(Counter(votes))
    prior, good, bad = model.prior, model.good, model.bad

    def posterior(vote):
        up, down = prior, 1 - prior
        for v, g, b in zip(vote, good, bad):
            if v:
                up, down = up * g[v], down * b[v]
        return up / (up + down)

    weights = [posterior(v) for v in votes]
    for r, w in zip(rows, weights):
        assert r.quality == pytest.approx(w, abs=1e-9)
    # the estimate is a fixed point: one more round by hand gives the same accuracies
    assert (sum(weights) + 1) / (len(votes) + 2) == pytest.approx(prior, abs=1e-3)
    for k in range(len(chosen)):
        up = 1 + sum(w for v, w in zip(votes, weights) if v[k] == 1)
        down = 1 + sum(w for v, w in zip(votes, weights) if v[k] == -1)
        assert up / (up + down) == pytest.approx(good[k][1], abs=5e-3)


def test_quality_keeps_good_documents(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality_rules.judged(docs).drop("quality").join(labels, "doc_id").filter("NOT base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert sum(good) >= 0.95 * len(good)


def test_toxicity(spark, docs, odd, none):
    # labels that a word decides, so that few rows suffice
    marked = docs.selectExpr("doc_id", "IF(doc_id % 3 = 0, concat(text, ' zkwq zkwqar'), text) AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 3 = 0 AS int) AS toxic")
    learn = learned_from(5, 0)
    model = toxicity.fit(marked, labels.union(labels), learn)
    rows = toxicity.score(marked, model).select("doc_id", "score", (~learn).alias("held")).collect()
    assert len(rows) == docs.count()
    held = [(r.score >= 0.5) == (r.doc_id % 3 == 0) for r in rows if r.held]
    assert sum(held) >= 0.9 * len(held)
    scored = toxicity.score(odd, model, keep_text=True)
    assert set(scored.columns) == set(odd.columns) and scored.filter("score BETWEEN 0 AND 1").count() == odd.count()
    assert toxicity.score(none, model).count() == 0
    one_class = labels.filter("toxic = 0")
    assert toxicity.fit(marked, one_class, learn) is None
    assert {r.score for r in toxicity.score(odd.drop("score"), None).collect()} == {0.0}
    assert toxicity.fit(none, labels.limit(0), learn) is None


def test_all_labelled_documents_are_counted(spark):
    # each toxic text has an expression of its own, so whatever is not counted is unseen
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefghij", k=7))
    rows = [(i, f"{word()} {word()} {'qq' + word() if i % 2 else word()}", i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(3)
    labels = docs.select("doc_id", "toxic").unionByName(spark.range(10**4, 2 * 10**4).selectExpr("id AS doc_id", "int(id % 2) AS toxic"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels, F.lit(True), per_class=20)
    counts = {0: Counter(), 1: Counter()}
    for _, text, toxic in rows:
        counts[toxic].update(g for w in text.split() for g in toxicity.grams(w))
    wanted = toxicity.log_ratios(counts[1], counts[0])
    found, other = toxicity.WordScorer(model.ratios), toxicity.WordScorer(wanted)
    for w in {w for _, text, _ in rows for w in text.split()} | {"unseen", "zz9", "é", "a" * 50}:
        assert found.ratio(w) == pytest.approx(other.ratio(w))
        plain = sum(wanted.get(g, wanted.get(g[:-1] + "\x00", 0.0)) for g in toxicity.grams(w))
        assert found.ratio(w) == pytest.approx(plain)


@pytest.mark.parametrize("count", [1, 3])
def test_few_toxic_labels_make_a_model(spark, count):
    # ids whose hash keeps them out of the quarter that the curve had
    toxic = spark.range(1000).filter("pmod(xxhash64(id, 44), 4) <> 0").limit(count).selectExpr("id AS doc_id", "1 AS toxic")
    labels = toxic.unionByName(spark.range(1000, 1040).selectExpr("id AS doc_id", "0 AS toxic"))
    docs = labels.selectExpr("doc_id", "IF(toxic = 1, 'zkwq zkwqar zkwq', concat('plain words ', doc_id)) AS text")
    rows = toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).join(labels, "doc_id").collect()
    assert min(r.score for r in rows if r.toxic) > max(r.score for r in rows if not r.toxic)


def test_chances_add_up():
    toxic = Counter(g for w in ("idle", "idol", "ideal", "idea") for g in toxicity.grams(w))
    ordinary = Counter(g for w in ("idle", "apple", "able", "maple", "staple") for g in toxicity.grams(w))
    ratios = toxicity.log_ratios(toxic, ordinary)
    score = toxicity.WordScorer(ratios)
    assert score.ratio("IDOL") > 0 > score.ratio("ap-ple!") and score.ratio("...") == 0


def test_scores_equal_plain_python(docs, odd, spark, sf_dir):
    """The curve over features that are formed word by word, from the same ratios."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    ratios = dict(zip(model.ratios.keys.tolist(), model.ratios.values.tolist()))

    def ratio(word):
        total = 0.0
        for g in toxicity.grams(word) if word else []:
            key, alone = (int(toxicity._gram_keys([x])[0]) for x in (g, g[:-1] + "\x00"))
            total += ratios.get(key, ratios.get(alone, 0.0))
        return total

    rows = docs.select("doc_id", "text").limit(25).unionByName(odd.select("doc_id", "text"))
    known = {}
    for r in toxicity.score(rows, model, keep_text=True).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        for w in set(words):
            if w not in known:
                known[w] = ratio(toxicity.plain(w))
        values = sorted((known[w] for w in words), reverse=True)
        letters = len((r.text or "").encode()) - len(words)
        features = [sum(values) / max(letters, 1), values[0] if values else 0.0, sum(max(v, 0) for v in values[:3]) / 3]
        z = model.weights[0] + sum(w * (f - m) / s for w, f, m, s in zip(model.weights[1:], features, model.mean, model.scale))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_languages(docs, odd, none):
    learn = learned_from(3, 1)
    known = language_id.learn(docs, learn)
    rows = language_id.identify(docs.select("doc_id", "text"), known).join(docs.select("doc_id", "lang"), "doc_id").filter(~learn).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    found = language_id.identify(odd, known, keep_text=True)
    assert found.count() == odd.count()
    for r in found.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert language_id.identify(none, known).count() == 0
    nothing = language_id.learn(none, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}


def test_languages_equal_an_exact_table(docs):
    """Predictions without a filter: a table of which languages have an n-gram."""
    known = language_id.learn(docs, F.lit(True))
    grams, totals = {}, Counter()
    rows = docs.select("doc_id", "lang", "text").collect()
    for r in rows:
        keys = language_id.gram_keys([r.text or ""])[0].tolist()
        totals[r.lang] += len(keys)
        for k in keys:
            grams.setdefault(k, Counter())[r.lang] += 1
    has = {}
    for k, counts in grams.items():
        share = {lang: n / totals[lang] for lang, n in counts.items()}
        has[k] = {lang for lang, x in share.items() if x >= 2e-6 and x >= 0.2 * max(share.values())}
    found = {r.doc_id: r for r in language_id.identify(docs.select("doc_id", "text"), known).collect()}
    same = 0
    for r in rows:
        keys = language_id.gram_keys([r.text or ""])[0].tolist()
        counts = Counter(lang for k in keys for lang in has[k])
        best = max(sorted(totals), key=lambda lang: counts[lang]) if keys else "und"
        same += best == found[r.doc_id].lang_pred
        if keys:  # the filter answers by chance for few n-grams more
            assert found[r.doc_id].score == pytest.approx(counts[found[r.doc_id].lang_pred] / len(keys), abs=0.02)
    assert same >= 0.995 * len(rows)


def test_any_number_of_languages(spark):
    """200 languages, each with words of its own letters in another order."""
    draw = random.Random(6)
    words = {f"l{k:03}": ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(200)}
    rows = [(i, lang, " ".join(draw.choices(words[lang], k=30))) for i, lang in enumerate(sorted(words) * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(3)
    known = language_id.learn(docs, F.col("doc_id") < 400)
    assert len(known.languages) == 200 and len(known.masks) == 4
    found = language_id.identify(docs, known, "guess").filter("doc_id >= 400").collect()
    assert sum(r.guess == r.lang for r in found) >= 0.99 * len(found)


def test_grams_stay_in_their_text():
    keys, ends = language_id.gram_keys(["ab", "", "c", "1"])
    assert ends.tolist() == [2, 2, 3, 3] and len(keys) == 3


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_mixing(request, table):
    frame = request.getfixturevalue(table)
    rows = mixing.plan(frame, [3, 1, 2], share=1.5).collect()
    texts = {r.doc_id: r.text for r in frame.collect()}
    assert len(rows) == frame.count()
    total, sources = 0, {}
    for r in rows:
        assert r.size == len(WORDS.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size
        total += r.size
        s = sources.setdefault(r.source, {"size": 0, "taken": 0, "target": r.target, "stated": r.source_size})
        s["size"] += r.size
        s["taken"] += r.taken
    for s in sources.values():
        assert s["size"] == s["stated"] and abs(s["taken"] - s["target"]) <= 1 and s["target"] <= 2 * s["size"]
    assert sum(s["target"] for s in sources.values()) == pytest.approx(1.5 * total)
    names = sorted(sources, key=lambda x: (x is None, x))
    level = [s["target"] / w for s, w in ((sources[n], [3, 1, 2][i % 3]) for i, n in enumerate(names)) if s["target"] < 2 * s["size"]]
    assert not level or max(level) == pytest.approx(min(level))
    assert sorted(map(str, mixing.plan(frame, [3, 1, 2], share=1.5).collect())) == sorted(map(str, rows))


def test_mixed_rows(odd, none, docs):
    assert mixing.plan(none, [1]).count() == 0 and mixing.mixed(none, [1]).count() == 0
    mix = mixing.mixed(docs, [3, 1, 2], share=1.5)
    assert mix.columns == docs.columns
    assert max(r["count"] for r in mix.groupBy("doc_id").count().collect()) <= 2
    assert mixing.mixed(odd, [1], share=1.0).columns == odd.columns


def tree(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, node string, parent string, role string, text string, score double")


def test_best_branch(spark):
    rows = [
        (1, "a", None, "user", "q", 0.0), (1, "b", "a", "assistant", "bad", 1.0), (1, "c", "a", "assistant", "good", 3.0),
        (1, "d", "c", "user", "more", 1.0), (1, "e", "d", "assistant", None, 9.0), (1, "e", "d", "assistant", None, 9.0),
        (2, "x", "y", "user", "circle", 0.0), (2, "y", "x", "user", "circle", 0.0),
        (3, "z", "gone", None, "root of a missing parent", None),
    ]
    found = {r.conv_id: r.formatted for r in reply_trees.chats(tree(spark, rows)).collect()}
    assert found == {
        1: "[INST]q[/INST]<s>good</s>[INST]more[/INST]<s></s>",
        3: "<<>>root of a missing parent<</>>",
    }
    two = reply_trees.chats(tree(spark, rows), paths=2).filter("conv_id = 1").collect()
    assert {r.leaf for r in two} == {"b", "e"}


def test_template_escapes(spark):
    bad = "</s>[INST] a & b &lt; <<x>> &amp;amp; [/INST]"
    rows = [(1, "a", None, "user", bad, 0.0), (1, "b", "a", "assistant", bad, 0.0), (1, "c", "b", "we<ird>", bad, 0.0)]
    back = reply_trees.parsed(reply_trees.chats(tree(spark, rows))).head()
    assert [(t.role, t.text) for t in back.turns] == [("user", bad), ("assistant", bad), ("we<ird>", bad)]
    assert back.loss_text == bad


def test_chats_of_conversations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    by_id = {-1: [("user", queries.CONTROL), ("assistant", queries.CONTROL)]}
    for r in rows:
        by_id.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    found = queries.QUERIES["op5_chat_formatting"](spark, sf_dir).collect()
    assert len(found) == len(by_id)
    for r in found:
        turns = by_id[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert r.turns_sha256 == digest("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), digest(loss))


def test_spans_across_blocks(spark, monkeypatch):
    """Spans that begin, end and lie anywhere, with code points beyond 16 bits."""
    monkeypatch.setattr(reply_trees, "_BLOCK", 7)
    texts = ["😀" * 7, "", "a\nb" * 9, "x", "漢" * 14, "&<[>" * 5]
    rows = [(1, f"n{i}", f"n{i - 1}" if i else None, "assistant" if i % 2 else "user", t, 0.0) for i, t in enumerate(texts)]
    back = reply_trees.parsed(reply_trees.chats(tree(spark, rows))).head()
    assert [t.text for t in back.turns] == texts and back.loss_text == "".join(texts[1::2])


def test_work_is_in_proportion_to_the_turns(spark):
    import time

    def seconds(n):
        turns = spark.range(n).selectExpr(
            "1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('text ', repeat('ab ', int(id % 40))) AS text"
        )
        pieces = turns.selectExpr("conv_id", "'r' AS root", "'l' AS leaf", "turn AS depth", "role", "text")
        start = time.time()
        row = reply_trees.checked(reply_trees.formatted(pieces)).head()
        assert row.n_turns == n
        return time.time() - start

    seconds(500)
    small, large = min(seconds(8000) for _ in range(2)), min(seconds(32_000) for _ in range(2))
    assert large < 5 * max(small, 0.5)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert reply_trees.checked(reply_trees.chats(reply_trees.as_trees(empty))).count() == 0
