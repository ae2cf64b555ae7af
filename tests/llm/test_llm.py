import random
import re

import numpy as np
import pytest

from millrace.llm import leakage, packing, truncation

DOCS = "doc_id bigint, text string, source string, lang string, n_tokens string, ending string"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, source, None, "clash", "clash") for i, t in enumerate(texts)], DOCS)


def test_tokens_are_wordpunct(spark):
    texts = ["", "a-b_c, d!!", "Größe… 12.5€ naïve", "\xa0x\x85y\x1cz　w", "日本語 テスト", "éa", "x" * 100_000 + "." * 5]
    from pyspark.sql import functions as F

    got = [r[0] for r in docs(spark, texts).orderBy("doc_id").select(packing.tokens(F.col("text"))).collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]+", t)) for t in texts]


def test_exceeding(spark):
    df = docs(spark, ["a " * 10, "a " * 11, None, "a " * 30, "", "a " * 20])
    exceeding = lambda df, sizes: sorted(tuple(r) for r in packing.exceeding(packing.pack(df, sizes), sizes).collect())
    assert exceeding(df, [10, 20]) == [(10, 1), (10, 3), (10, 5), (20, 3)]
    assert exceeding(df, [10]) == [(10, 1), (10, 3), (10, 5)]
    assert exceeding(df, []) == exceeding(df.limit(0), [10]) == []


def test_shards_are_bounded_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    df = docs(spark, ["a " * 1000, "b " * 1000, "c"])
    per = [r["count"] for r in packing.pack(df, [10]).groupBy("shard").count().collect()]
    assert sum(per) == 201 and len(per) == 5 and max(per) < 100


def test_pack_shard_keeps_everything_within_capacity():
    rnd = random.Random(4)
    caps = [10, 20, 40]
    sizes = np.array([rnd.randint(1, 40) for _ in range(500)])
    tiers = np.array([min(c for c in caps if c >= s) for s in sizes])
    where, capacity, filled = packing.pack_shard(sizes, tiers, caps)
    assert (where >= 0).all()
    used = np.bincount(where, weights=sizes, minlength=len(capacity))
    assert list(used) == filled and all(f <= c for f, c in zip(filled, capacity))
    assert all(capacity[w] >= t for w, t in zip(where, tiers))
    assert sum(filled) / sum(capacity) > 0.97
    group = packing.steps(capacity, filled, 4)
    assert max(np.bincount(group)) <= 4 and len(set(zip(group, capacity))) == len(set(group))


def test_pack_splits_only_what_exceeds(spark):
    df = docs(spark, ["a " * 95, "b " * 40, "c " * 5, "", None])
    rows = packing.pack(df, [10, 40]).collect()
    assert sorted((r["doc_id"], r["piece"], r["size"]) for r in rows) == [(0, 0, 40), (0, 1, 40), (0, 2, 15), (1, 0, 40), (2, 0, 5)]
    assert packing.pack(df.limit(0), [10]).count() == 0


ITEM = " ".join(f"w{i}" for i in range(60))


def leaks(spark, texts, items=(ITEM,)):
    it = spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(items)], "item_id bigint, text string, doc_id string")
    return sorted((r["doc_id"], r["item_id"]) for r in leakage.leaks(docs(spark, texts), it).collect())


def test_leaks(spark):
    w = ITEM.split()
    edited = list(w[10:40])
    edited[7], edited[14], edited[21] = "zz", "yy", "qq"
    four = list(w[10:40])
    for i in (5, 11, 17, 23):
        four[i] = "zz"
    put_in = w[5:12] + ["extra"] + w[12:19] + ["extra"] + w[19:25]
    texts = [
        "before " + " ".join(w[3:23]) + " after", " ".join(w[3:22]), " ".join(edited), " ".join(four), " ".join(put_in), " ".join(x.upper() + "," for x in w[20:45]),
        "\n".join(f"{i}. <b>{x}</b>" for i, x in enumerate(w[20:45])), " ".join(w[:30] + w[40:]), None, "", "lorem " * 50_000 + " ".join(w[:25]), " ".join(w[3:23]),
    ]
    assert leaks(spark, texts) == [(i, 100) for i in (0, 2, 4, 5, 6, 7, 10, 11)]


def test_leaks_of_repeated_wording(spark):
    refrain = " ".join(["row row row your boat"] * 8)
    assert leaks(spark, ["so " + " ".join(refrain.split()[:20]) + " on", " ".join(refrain.split()[:19])], items=(refrain,)) == [(0, 100)]


def test_leaks_of_nothing(spark):
    assert leaks(spark, [ITEM], items=()) == leaks(spark, [ITEM], items=(None, "", "too short")) == leaks(spark, []) == []


def brute(doc, item):
    """Longest run by plain recursion over (doc position, item position, edits, length)."""
    best = 0
    for s in range(len(item)):
        for d in range(len(doc)):
            if doc[d] != item[s]:
                continue
            todo, seen = [(d, s, 0, 1)], set()
            while todo:
                x = todo.pop()
                if x in seen:
                    continue
                seen.add(x)
                d0, i0, e, n = x
                if doc[d0] == item[i0] and n >= leakage.RUN and e * 10 <= n:
                    best = max(best, n)
                for gap in (1, 2):
                    if d0 + gap < len(doc) and i0 + 1 < len(item):
                        same = doc[d0 + gap] == item[i0 + 1]
                        if gap == 1 or same:
                            cost = e + (gap == 2 or not same)
                            if cost <= len(item) // 10:
                                todo.append((d0 + gap, i0 + 1, cost, n + 1))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_alignment_against_brute_force(seed):
    rnd = random.Random(seed)
    item = [rnd.randrange(30) for _ in range(34)]
    doc = list(item[rnd.randrange(6) :])
    for _ in range(rnd.randrange(4)):
        at = rnd.randrange(len(doc))
        if rnd.random() < 0.5:
            doc[at] = 99
        else:
            doc.insert(at, 98)
    assert leakage.align(np.array(doc), np.array(item))[0] == brute(doc, item)


def test_endings():
    end = lambda t: truncation.ending_of(t)[0]
    assert [end(t) for t in ("It ended.", "It did?", 'He said "no."', "x\n```\ncode\n```", "x\n```\ncode", "the mai", "half �", "soft=", "cut [...", "  ")] == [
        "stop", "stop", "stop", "block", "open_block", "open", "broken", "broken", "broken", "empty",
    ]
    assert truncation.ending_of("x.\n-- \nEdge crew") == ("closing", "Edge crew")
    assert truncation.ending_of("x.\n\nRef: TK-123") == ("closing", "TK-9")
    assert truncation.ending_of("a: x.\nb.c: let us see...") == ("closing", "let us see...")
    assert truncation.ending_of("the Mai") == ("open", "mai") and truncation.ending_of("port 12") == ("open", "")
    assert {end(t) for t in ("هل انتهى العمل؟", "काम हो गया।", "作業は終わった。」", "Ya está?)**", "完了！", "Սա վերջն է։", "x" * 5000 + ".")} == {"stop"}
    long = "Signed by the whole of the night shift, " * 5
    assert truncation.ending_of(f"x.\n-- \n{long}") == ("closing", long.strip()) and end("Kind regards from all of us at the relay desk of the north,\nAda") == "closing"


def test_a_source_without_end_marks_is_no_source_of_cuts(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(4, 9))) for _ in range(120)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    titles = [prose(rnd.randint(4, 9)) for _ in range(300)]
    whole = [prose(rnd.randint(20, 60)) + "." for _ in range(300)]
    cut = [prose(40)[: rnd.randint(90, 200)] for _ in range(60)]
    cut = [t if not t.endswith(" ") else t[:-3] for t in cut]
    df = docs(spark, titles, "titles").unionByName(docs(spark, whole + cut, "prose").selectExpr("doc_id + 1000 AS doc_id", "text", "source", "lang", "n_tokens", "ending"))
    got = {r["doc_id"] for r in truncation.judged(df).where(f"posterior >= {truncation.CUT}").collect()}
    assert not {i for i in got if i < 1300} and len(got) >= 55


def test_long_signatures_close_a_text_if_they_recur(spark):
    rnd = random.Random(9)
    prose = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(50, 400))) + "."
    signature = "Written by the operators of the northern relay desk, who can be reached at any hour of the day"
    assert len(signature) > truncation.KEY_CHARS
    signed, cut = [f"{prose()}\n-- \n{signature}" for _ in range(40)], [f"{prose()}\n-- \n{signature[:88]}"]
    got = {r["doc_id"] for r in truncation.judged(docs(spark, signed + cut + [prose() for _ in range(100)])).where(f"posterior >= {truncation.CUT}").collect()}
    assert got == {40}


def test_censored_fit_finds_what_the_limit_hides():
    rnd = np.random.default_rng(1)
    x = np.exp(rnd.normal(6.5, 0.6, 4000))
    cut = np.minimum(x, 900).round()
    v, n = np.unique(cut, return_counts=True)
    mu, sd = truncation.censored_fit(v, n.astype(float), 900.0)
    assert abs(mu - 6.5) < 0.05 and abs(sd - 0.6) < 0.05


def test_judged(spark):
    rnd = random.Random(2)
    whole = ["".join(rnd.choice("abcdef ") for _ in range(rnd.randint(30, 160))) + "." for _ in range(150)]
    limited = [t[:99] + "q" if len(t) > 100 else t for t in whole]  # a field of 100 characters
    exact = "x" * 99 + "."
    df = docs(spark, whole, None).unionByName(docs(spark, [*limited, exact, "", None], "cutter").withColumn("doc_id", __import__("pyspark.sql.functions", fromlist=["x"]).col("doc_id") + 1000))
    j = {r["doc_id"]: r for r in truncation.judged(df).collect()}
    got = {k for k, r in j.items() if r["posterior"] >= truncation.CUT}
    assert got == {1000 + i for i, t in enumerate(limited) if t.endswith("q")}
    assert j[1000]["limit"] == 100 and j[0]["limit"] is None
    rate = {r["source"]: r["n_cut"] for r in truncation.rates(truncation.judged(df)).collect()}
    assert rate == {None: 0, "cutter": len(got)}


def test_judged_nothing(spark):
    assert truncation.judged(docs(spark, [])).count() == 0
    assert [r["posterior"] < 0.5 for r in truncation.judged(docs(spark, ["Only one.", None, ""])).collect()] == [True, True]


def test_dots_close_a_text_only_as_a_phrase(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 9)))
    prose = lambda: " ".join(word() for _ in range(25)) + "."
    whole = [f"{prose()}\nThe lease table dropped {i} entries before noon." for i in range(300)]
    # cuts of one frequent line at the same place, in two texts and in copies that differ in digits only
    cut = [f"{prose()}\nThe lease table d..." for _ in range(2)] + ["Tried 12 times.\nClear the dead let...", "Tried 34 times.\nClear the dead let..."]
    phrase = [f"{prose()}\nlet us see what comes..." for _ in range(12)]
    got = {r["doc_id"] for r in truncation.judged(docs(spark, whole + cut + phrase)).where(f"posterior >= {truncation.CUT}").collect()}
    assert got == set(range(300, 304))


def test_limits_in_bytes_and_several(spark):
    rnd = random.Random(3)
    made = lambda n: "".join(rnd.choice("abcdefü ") for _ in range(n))
    whole = [made(rnd.randint(60, 2500)) + "." for _ in range(300)]
    in_bytes = []
    while len(in_bytes) < 40:
        t = made(400).encode()[:400]
        if t[-1] < 128 and t[-1] != 32:
            in_bytes.append(t.decode())
    longer = [made(1199) + "q" for _ in range(20)]  # a second limit, in characters
    texts = [*whole, *in_bytes, "x" * 397 + "\ufffd", *longer, "y" * 399 + "\ufffd"]
    df = docs(spark, texts)
    fit = truncation.source_fits(df.selectExpr("source", "xxhash64(text) AS fold", "length(text) AS chars", "octet_length(text) AS bytes", "endswith(text, '\ufffd') AS replaced")).first()
    assert [(x["limit"], x["unit"]) for x in fit["limits"]] == [(400, "bytes"), (1200, "chars")]
    j = {r["doc_id"]: r["censored"] for r in truncation.judged(df).collect()}
    assert all(j[i] > 0.9 for i in range(300, 361)) and j[361] > 0.9
    assert sum(j[i] > 0 for i in range(300)) < 15


def edited_run(rnd, item, n):
    """n successive item words of which one in ten is altered or has a word put in before it; the ends stay."""
    lo = rnd.randrange(len(item) - n + 1)
    run, edits = list(item[lo : lo + n]), n // 10
    places = sorted(rnd.sample(range(1, n - 1), edits), reverse=True)
    for at in places:
        if rnd.random() < 0.5:
            run[at] = "zz"
        else:
            run.insert(at, "yy")
    return run


@pytest.mark.parametrize("seed", range(6))
def test_seeds_lose_no_leak(seed):
    rnd = random.Random(seed)
    item = [f"w{rnd.randrange(25)}" for _ in range(60)]
    h = leakage.hashes_of
    spread = {int(g): rnd.randrange(1000) for g in leakage.grams(h(item))}
    seeds = leakage.Seeds({7: h(item)}, spread)
    for _ in range(150):
        doc = ["a"] * 30 + edited_run(rnd, item, rnd.randint(20, 59)) + ["b"] * 30
        gs = leakage.grams(h(doc))
        assert leakage.close(np.flatnonzero(leakage._held(gs, seeds.known))), doc
        assert [x[0] for x in leakage.leaked_in(h(doc), seeds)] == [7]
    # all edits in the middle of a run of 30, in every window of 20 words of it
    mid = item[:30]
    for at in (12, 14, 16):
        mid[at] = "zz"
    assert leakage.leaked_in(h(mid), leakage.Seeds({7: h(item)}, spread))


def test_markup_of_any_length_does_not_count(spark):
    w = ITEM.split()
    tag = f'<a href="{"x" * 5000}" title=\'a > b\' checked data-n=1 />'
    assert leakage.words_of(f"one{tag}two <!-- three --> </b>four") == ["one", "two", "four"]
    assert leakage.words_of("a < b and c > d, x<y") == ["a", "b", "and", "c", "d", "x", "y"]
    assert leaks(spark, [" ".join(w[:10]) + tag + " ".join(w[10:20])]) == [(0, 100)]


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    items = [ITEM, ITEM.replace("w", "v"), "short", None, " ".join(f"u{i % 7}" for i in range(40))]
    texts = [ITEM, " ".join(items[1].split()[5:30]), items[4], "nothing", None]
    whole = leaks(spark, texts, items)
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 100)
    assert leaks(spark, texts, items) == whole == [(0, 100), (1, 101), (2, 104)]
