"""One test per finding of the second review."""
import collections
import math
import struct

import numpy as np

import public_tokenizers
from tokenizers import Tokenizer

from narralytics.llm import bpe, mixing, pii, word_lm
from tests.llm.helpers import awkward, by_id, count, documents, empty, prose


# op9_lm_difference

def plain_words(text):
    out, run = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum() and not "一" <= c <= "鿿":
            run += c
            continue
        out += [run] * bool(run) + [c] * (not c.isspace())
        run = ""
    return out + ["</s>"]


def plain_losses(texts, vocabulary):
    pairs, one, before = collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        s = plain_words(t)
        one.update(s)
        before.update(["<s>", *s[:-1]])
        pairs.update(zip(["<s>", *s], s))

    def loss(v, w):
        shorter = (one[w] + word_lm.MASS / len(vocabulary)) / (sum(one.values()) + word_lm.MASS)
        return -math.log2((pairs[v, w] + word_lm.MASS * shorter) / (before[v] + word_lm.MASS))

    return loss


def test_word_models_tell_words_apart_and_keep_the_larger_counts(spark):
    background = [prose(i, 60) for i in range(12)] + [None, "", "日本 12 :)", "日本 13 :)", "日本 13 :)", "one 2024", "one 2025"]
    target = ["winter music, winter 2024.", "日 silver paper"]
    got = word_lm.cross_entropy_difference(documents(spark, background), spark.createDataFrame([(t,) for t in target], "text string"))
    vocabulary = {w for t in background + target for w in plain_words(t)}
    models = [plain_losses(t, vocabulary) for t in (target, background)]
    found = by_id(got)
    assert len(found) == len(background)
    for i, text in enumerate(background):
        s = plain_words(text)
        want = [sum(m(v, w) for v, w in zip(["<s>", *s], s)) / len(s) for m in models]
        assert found[i].n_tokens == len(s)
        assert abs(found[i].target_loss - want[0]) < 1e-9 and abs(found[i].background_loss - want[1]) < 1e-9
        assert abs(found[i].difference - (want[0] - want[1])) < 1e-9
    assert found[17].difference < found[18].difference   # digits are not one symbol: the target has 2024
    assert count(word_lm.cross_entropy_difference(awkward(spark), empty(spark).select("text"))) == 8
    assert count(word_lm.cross_entropy_difference(empty(spark), awkward(spark))) == 0


# op2_pii

def test_candidates_in_other_forms_are_added_and_failing_ones_are_not(spark):
    plain = ["mail me@host.org now", "call +49 (017) 555-7713 now", "card 4111 1111 1111 1111 now", "from 10.1.2.3 now"]
    odd = ["mail me [at] host [dot] org now", "call (017) 555-7713 now", "card 4111.1111.1111.1111 now", "from 10[.]1[.]2[.]3 now"]
    bad = ["meet me (at) noon. Then go", "call (017) 555-77 now", "card 4111.1111.1111.1112 now", "from 10[.]1[.]2[.]300 now", "at 10,11,12,13 now"]
    kinds = ["email", "phone", "card", "ip"]
    copies = 10   # the odd forms are frequent beside the plain ones
    got = by_id(pii.report(documents(spark, odd * copies + bad + plain * 5)))
    for i in range(len(odd) * copies):
        assert got[i].spans.split(":")[0] == kinds[i % 4] and "," not in got[i].spans, odd[i % 4]
    assert [got[len(odd) * copies + i].spans for i in range(len(bad))] == [""] * len(bad)


# op7_bpe

def test_capitals_that_compose_only_when_small():
    path = public_tokenizers.path(bpe.VOCABULARY)
    words, codec = Tokenizer.from_file(path), bpe.Codec(path)
    texts = ["J\u030cohn", "H\u0331 T\u0308 W\u030a Y\u030a", "A J\u0323\u030cX É JOHN", "J", "É J"]
    for text, (ids, decoded) in zip(texts, codec.encode([t.encode() for t in texts])):
        want = words.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
        assert decoded.decode() == words.decode(want, skip_special_tokens=False)


# op8_mixing

def test_margins_that_can_be_met_are_met_under_the_bound(spark):
    targets = mixing.Targets({"a": 0.5, "b": 0.5}, {"x": 0.5, "y": 0.5}, {"p": 0.5, "q": 0.5})
    tokens = {(s, t, u): (300 if s == "a" else 700) * (3 if t == "x" else 2) if u == "p" else (10 if s == "a" else 90)
              for s in "ab" for t in "xy" for u in "pq"}   # q has too little
    kept = mixing.probabilities(tokens, mixing.rake(tokens, targets), 0.5)
    total = lambda axis, value: sum(tokens[k] * p for k, p in kept.items() if k[axis] == value)
    want = 0.5 * sum(tokens.values())
    assert all(0 <= p <= 1 for p in kept.values()) and abs(total(2, "q") - 200) < 1e-3 and abs(total(2, "p") - want + 200) < 1e-3
    for axis, values in enumerate(("ab", "xy")):
        room = [min(want / 2, sum(n for k, n in tokens.items() if k[axis] == v)) for v in values]
        assert min(room) == want / 2 or axis == 0
        for v, r in zip(values, room):
            assert abs(total(axis, v) / want - (r if r < want / 2 else want - min(room)) / want) < 1e-3, (axis, v)


def test_topics_are_fitted_on_all_rows(spark):
    rng = np.random.default_rng(5)
    kinds = ["oven salt soup bake onion pepper".split(), "mast wind harbour rope anchor deck".split()]
    texts = [" ".join(rng.choice(kinds[i % 2], 12)) for i in range(6000)]     # more rows than a sample of 4 096
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = mixing.topic_model(docs)
    vectors, _ = mixing.word_vectors([t.encode() for t in texts])
    assert np.allclose(model.means["en"], vectors.mean(axis=0), atol=1e-12)
    rest = model.rest(vectors, ["en"] * len(texts))
    rest /= np.linalg.norm(rest, axis=1, keepdims=True)
    owner = (rest @ model.centroids.T).argmax(axis=1)
    assert len(model.centroids) == mixing.TOPICS and all(len({i % 2 for i in np.flatnonzero(owner == k)}) == 1 for k in range(mixing.TOPICS))
    assert (np.diff(np.bincount(owner)) <= 0).all()
    again = mixing.topic_model(docs.repartition(7))
    assert np.allclose(again.centroids, model.centroids, atol=1e-9)
    one = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    assert mixing.topic_model(one).names([b"a b", b""], ["en", "en"])[0] == ["topic0", mixing.EMPTY]


def test_sources_of_the_table_are_the_default_targets(spark):
    docs = documents(spark, [prose(i, 50) for i in range(40)]).selectExpr("doc_id", "text", "lang", "CASE WHEN doc_id < 30 THEN 'books' ELSE 'news' END AS source")
    got = mixing.mix(docs).collect()
    share = collections.Counter()
    for r in got:
        share[r.source] += r.n_tokens * r.weight
    assert set(share) == {"books", "news"} and abs(share["books"] - share["news"]) < 1e-6 * share["news"]
