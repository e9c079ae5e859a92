import math
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarrymill.llm import contamination as ct, packing as pk, stuffing as sf
from quarrymill.llm.distinctive_terms import distinctive_terms
from quarrymill.plans import skew
from tests.conftest import rows

FOLDER = "/opt/tokenizers"


def test_term_scores_by_hand_and_ties(spark):
    data = [("b1", "good", 6), ("b1", "food", 6), ("b1", "nice", 6), ("b1", "one", 1), ("b2", "good", 5), (None, "x", 9), ("b2", None, 9)]
    counts = spark.createDataFrame(data, "b string, word string, f long")
    got = distinctive_terms(counts, "b", 8, min_f=5, top=2).orderBy("b", F.desc("score"), "word").collect()
    assert [tuple(r) for r in got] == [("b1", "food", 6, 1, 3.0), ("b1", "nice", 6, 1, 3.0), ("b2", "good", 5, 2, 2.0)]
    smooth = {(r["b"], r["word"]): r["score"] for r in distinctive_terms(counts, "b", 8, norm="l2", smooth=True).collect()}
    assert abs(smooth["b1", "one"] - math.log2(9) / math.sqrt(109)) < 1e-12
    length = {(r["b"], r["word"]): r["score"] for r in distinctive_terms(counts, "b", 8, norm="length").collect()}
    assert abs(length["b1", "one"] - 3 / 19) < 1e-12
    assert rows(distinctive_terms(counts.limit(0), "b", 8)) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=120))
def test_packing_never_overfills_or_overlaps(sizes):
    sizes = np.array(sizes)
    bins, at = pk.pack_sizes(sizes, 100)
    for b in set(bins.tolist()):
        spans = sorted((a, a + s) for a, s in zip(at[bins == b], sizes[bins == b]))
        assert spans[0][0] >= 0 and spans[-1][1] <= 100 and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    # any two thirds of bins hold more than a third of their room, far below what is reached
    assert len(set(bins.tolist())) == bins.max() + 1 <= 2 * math.ceil(sizes.sum() / 100) + 6


def test_packing_is_tight_on_mixed_lengths():
    sizes = np.minimum(2048, np.random.default_rng(1).lognormal(5.5, 1, 20_000).astype(int) + 1)
    bins, _ = pk.pack_sizes(sizes, 2048)
    assert sizes.sum() / (2048 * (bins.max() + 1)) > 0.99


def test_documents_are_packed_whole(spark):
    data = [(1, "word " * 5000, "x"), (2, None, "x"), (3, " \n", "x"), (4, "short one", "x"), (4, "short one", "x"), (None, "a text", "x"), (5, "a" * 200_000, "x"), (6, "", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, container string").repartition(2, "container")
    got = pk.pack_documents(df, FOLDER, window=3).collect()
    count = pk.token_counter(FOLDER)
    per = Counter()
    for r in got:
        per[r["doc_id"]] += r["tokens"]
    assert per == {1: count([data[0][1]])[0], 4: 2 * count(["short one"])[0], None: count(["a text"])[0], 5: count([data[6][1]])[0]}
    load = Counter()
    for r in got:
        load[r["container"]] += r["tokens"]
        assert r["at"] + r["tokens"] <= 2048 and r["token_from"] == r["piece"] * 2048
        assert r["doc_id"] in (1, 5) or r["piece"] == 0
    assert max(load.values()) <= 2048
    assert rows(pk.pack_documents(df.limit(0), FOLDER)) == []


def test_containers_do_not_depend_on_the_partitioning(spark):
    draw = random.Random(5)
    data = [(k, "word " * draw.choice([3, 40, 500, 3000])) for k in range(120)] + [(3, "again")] * 4 + [(None, "x")] * 3
    df = spark.createDataFrame(data, "doc_id long, text string")
    one, other = (sorted(map(str, pk.pack_documents(d, FOLDER, window=30).collect())) for d in (df.coalesce(1), df.repartition(7)))
    assert one == other and len({r.split("'")[1].split("-")[0] for r in one}) > 2


def test_long_white_space_is_counted_exactly():
    plain, cut = pk.token_counter(FOLDER, 10**9), pk.token_counter(FOLDER, 4)
    draw = random.Random(6)
    texts = ["".join(draw.choice(["a", "it's", " ", "  ", "\n\n\n", "\t", "\u3000", "\x1c", "7", "!?", "é"]) for _ in range(60)) for _ in range(300)]
    texts += [" " * 9, "x" + " " * 9, " " * 9 + "x", "\x1c" * 9 + "x", "\n" * 5 + "  !"]
    assert cut(texts) == plain(texts)
    assert pk.token_counter(FOLDER)(["a" + " " * 2_000_000 + "b"])[0] > 1000  # beyond what the pattern takes


def align(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_scores_equal_the_plain_table():
    rng = np.random.default_rng(0)
    a = [rng.integers(0, 4, rng.integers(1, 20)).astype(np.int32) for _ in range(120)]
    b = [rng.integers(-1, 4, rng.integers(1, 30)).astype(np.int32) for _ in range(120)]
    assert ct.smith_waterman(a, b) == [align(x, y) for x, y in zip(a, b)]


def test_scores_of_very_long_items():
    a = np.arange(20_000, dtype=np.int32)
    edited = a.copy()
    edited[9::10] = -1
    assert ct.smith_waterman([a], [a]) == [40_000] and ct.smith_waterman([a], [edited]) == [2 * 18_000 - 1999]


def test_a_long_edited_copy_is_found_beside_short_items(spark):
    words = [f"a{k}" for k in range(22_000)]
    edited = " ".join("changed" if k % 7 == 6 else w for k, w in enumerate(words))
    items = spark.createDataFrame([(1, " ".join(words)), (2, "one short item of seven words only")], "item_id long, text string")
    docs = spark.createDataFrame([(5, "before " + edited + " one short item of seven words only")], "doc_id long, text string")
    got = {r["item_id"]: (r["run"], r["score"]) for r in ct.leaked_items(docs, items).collect()}
    assert got[2] == (7, 14) and got[1][0] == 6 and got[1][1] > 33_000


def test_recall_of_random_edits(spark):
    """Words changed, dropped or put in at random, at several rates; planted among other text."""
    draw = random.Random(11)
    vocabulary = [f"v{k}" for k in range(400)]
    items = {i: [draw.choice(vocabulary) for _ in range(draw.randrange(20, 120))] for i in range(60)}
    docs, rates = [], {}
    for rate in (0.05, 0.1, 0.15, 0.2):
        for i, w in items.items():
            out = []
            for x in w:
                kind = draw.random()
                if kind < rate / 2:
                    out.append("changed")
                elif kind < 0.75 * rate:
                    out += [x, "added"]
                elif kind >= rate:
                    out.append(x)
            rates[len(docs)] = (rate, i)
            docs.append((len(docs), " ".join([draw.choice(vocabulary) for _ in range(50)] + out + [draw.choice(vocabulary) for _ in range(50)])))
    got = ct.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"))
    pairs = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    for rate in (0.05, 0.1, 0.15, 0.2):
        own = [d for d, (r, _) in rates.items() if r == rate]
        assert sum((d, rates[d][1]) in pairs for d in own) / len(own) >= 0.9, rate
    assert len(pairs) <= len(docs)  # nothing else


def test_longest_run():
    item, doc = np.arange(6), np.array([9, 1, 2, 3, 9, 5])
    assert ct.longest_run(item, doc, 0) == 3 and ct.longest_run(item, doc, 100) == 0 and ct.longest_run(item, doc, -5) == 0


def brute_leaks(docs, items):
    out = set()
    for d, t in docs:
        w = ct.words(t)
        for i, x in items:
            v = ct.words(x)
            n = min(12, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            if n and d is not None and i is not None and any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    draw = random.Random(9)
    vocabulary = [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(k, text(draw.choice([1, 2, 3, 5, 11, 12, 13, 40]))) for k in range(40)] + [(90, None), (91, " <a> "), (None, text(20)), (92, "Shared PASSAGE of more<br>than twelve words in a row, which two items have here")]
    items.append((93, items[-1][1] + " indeed"))
    docs = []
    for k in range(60):
        i = draw.choice(items)[1] or ""
        w = i.split()
        cut = draw.randrange(0, max(1, len(w) - 11))
        docs.append((k, text(draw.randrange(40)) + " " + " ".join(w[cut : cut + draw.choice([11, 12, 30])]).replace(" ", draw.choice([" ", ", ", "\r\n", " <i class='x y'>"])) + " " + text(5)))
    docs += [(70, None), (71, ""), (None, items[3][1]), (72, "x " * 50_000 + items[-1][1]), (73, docs[5][1]), (5, docs[5][1])]
    frames = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for block in (10**6, 60):
        got = ct.leaked_items(*frames, block_words=block)
        exact = {(r["doc_id"], r["item_id"]) for r in got.collect() if r["run"] >= min(12, r["item_words"])}
        assert exact == brute_leaks(docs, items)
    assert got.count() == got.select("doc_id", "item_id").distinct().count()


def test_edited_copy_is_scored(spark):
    item = " ".join(f"a{k}" for k in range(40))
    edited = " ".join("changed" if k % 9 == 4 else f"a{k}" for k in range(40) if k != 20)
    docs = spark.createDataFrame([(1, "before " * 30 + edited + " after" * 30), (2, "nothing of the kind")], "doc_id long, text string")
    got = ct.leaked_items(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["run"] < 12) for r in got] == [(1, 7, True)] and got[0]["score"] >= 40
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rows(ct.leaked_items(none, spark.createDataFrame([(7, item)], "item_id long, text string"))) == []
    assert rows(ct.leaked_items(docs, spark.createDataFrame([], "item_id long, text string"))) == []


def test_an_exact_copy_elsewhere_does_not_hide_an_edited_one(spark):
    item = [f"a{k}" for k in range(60)]
    edited = ["changed" if k % 6 == 5 else w for k, w in enumerate(item)]
    data = [(1, "before " * 30 + " ".join(item)), (2, "before " * 30 + " ".join(edited) + " after" * 30), (3, " ".join(item[:8]) + " after" * 30)]
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = ct.leaked_items(spark.createDataFrame(data, "doc_id long, text string"), items).collect()
    assert sorted((r["doc_id"], r["run"], r["score"]) for r in got) == [(1, 60, 120), (2, 5, align(item, edited))]


PLACES, THINGS, LOOKS = ["Ashby", "Norcot", "Velby", "Tamsin"], ["soup", "bread", "chair", "lamp", "tea", "cake", "door"], ["warm", "odd", "plain", "bright", "small"]


def prose(draw, n):
    kinds = ["We stopped by in {p} and the {t} was {l}, which my sister liked.", "The {t} is {l}, but the {u} makes up for it.", "They said the {t} would be back, so we had the {u} instead.", "It used to be {l}; now the {t} in {p} is rather {m}."]
    fill = lambda s: s.format(p=draw.choice(PLACES), t=draw.choice(THINGS), u=draw.choice(THINGS), l=draw.choice(LOOKS), m=draw.choice(LOOKS))
    return " ".join(fill(draw.choice(kinds)) for _ in range(n))


def spam(draw, n):
    phrase = f"cheap {draw.choice(THINGS)} near me"
    kinds = [lambda: " ".join([phrase] * n), lambda: " ".join(f"{draw.choice(LOOKS)} {draw.choice(THINGS)} /" for _ in range(2 * n)), lambda: "\n".join(f"http://x{draw.randrange(999)}.example/{draw.choice(THINGS)}" for _ in range(4 * n))]
    return draw.choice(kinds)()


def corpus(seed, n):
    draw = random.Random(seed)
    data = []
    for k in range(n):
        kind = draw.random()
        data.append((k, spam(draw, 12), True) if kind < 0.3 else (k, prose(draw, 12) + "\n" + spam(draw, 3), False) if kind < 0.5 else (k, prose(draw, 12), False))
    return data


def test_held_out_pages_are_told_apart(spark):
    data = corpus(1, 400)
    draw = random.Random(2)
    labels = [(k, "stuffed" if s != (draw.random() < 0.03) else "ordinary") for k, _, s in data[:200]] + [(3, "ordinary"), (None, "stuffed"), (5, None), (999, "stuffed")]
    docs = spark.createDataFrame([(k, t) for k, t, _ in data], "doc_id long, text string").withColumn("label", F.lit("stuffed"))
    got = {r["doc_id"]: 2 * r["stuffed_words"] > r["words"] for r in sf.stuffed_pages(docs, spark.createDataFrame(labels, "doc_id long, label string")).collect()}
    right = [got[k] == s for k, _, s in data[200:]]
    assert len(got) == 400 and sum(right) / len(right) > 0.97


def test_mutual_information_and_repeated_pairs_alone_tell_most_apart(spark):
    data = corpus(6, 400)
    docs = spark.createDataFrame([(k, t) for k, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, "stuffed" if s else "ordinary") for k, _, s in data[:200]], "doc_id long, label string")
    got = {r["doc_id"]: 2 * r["stuffed_words"] > r["words"] for r in sf.stuffed_pages(docs, labels, only=(0, 1, 2, 3)).collect()}
    assert sum(got[k] == s for k, _, s in data[200:]) / 200 > 0.9


def test_keys_of_very_many_documents_are_brought_back_apart(spark, monkeypatch):
    draw = random.Random(8)
    docs = spark.createDataFrame([(k, prose(draw, 6) + " closing words") for k in range(40)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label string")
    plain = rows(sf.stuffed_pages(docs, none, vocabulary=3))
    monkeypatch.setattr(skew.attach_counts, "__defaults__", (5,))
    assert rows(sf.stuffed_pages(docs, none, vocabulary=3)) == plain


def test_pages_without_labels_nulls_and_long_texts(spark):
    draw = random.Random(3)
    data = [(1, None), (2, "  \n"), (3, ""), (4, "one"), (5, prose(draw, 10_000)), (6, "cheap soup near me " * 50), (None, "x y"), (7, "short"), (7, "a longer version")]
    none = spark.createDataFrame([], "doc_id long, label string")
    got = {r["doc_id"]: r for r in sf.stuffed_pages(spark.createDataFrame(data, "doc_id long, text string"), none).collect()}
    assert sorted(got) == [4, 5, 6, 7] and got[7]["words"] == 3 and got[5]["words"] > 100_000
    assert got[6]["stuffed_words"] > 100 and 2 * got[5]["stuffed_words"] < got[5]["words"]
    assert rows(sf.stuffed_pages(spark.createDataFrame([], "doc_id long, text string"), none)) == []


def test_features_do_not_depend_on_the_neighbouring_document():
    encode = sf.Encoder()
    a, b = encode("one two one two http://a.example/b three."), encode("two one # 4 |")
    corpus_ = sf.Corpus(np.unique(np.concatenate([a, b]) >> sf.MARKS))
    corpus_.finish(np.ones((corpus_.size, corpus_.size), np.int64))
    both = sf.word_features(np.concatenate([a, b]), np.array([len(a), len(b)]), corpus_)
    apart = np.vstack([sf.word_features(x, np.array([len(x)]), corpus_) for x in (a, b)])
    assert np.allclose(both, apart, atol=1e-5)


def test_words_beyond_the_table_have_counts_of_their_own(spark):
    draw = random.Random(4)
    data = [(k, prose(draw, 12) + f" seldom{k % 9} said.") for k in range(60)] + [(100, "zirconium " * 100 + prose(draw, 3)), (101, "tungsten ")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label string")
    small, large = ({r["doc_id"]: r for r in sf.stuffed_pages(docs, none, vocabulary=v).collect()} for v in (5, 4096))
    assert small.keys() == large.keys()
    assert all(abs(small[k]["mean_pmi"] - large[k]["mean_pmi"]) < 0.02 for k in large)
    assert abs(small[100]["stuffed_words"] - large[100]["stuffed_words"]) <= 2
