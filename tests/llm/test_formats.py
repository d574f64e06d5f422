"""Chat templates, URL filters, quality rules, mixtures and fixity audits."""

import hashlib
import re

from pyspark.sql import functions as F

from sightline.llm import chat, fixity, mixture, queries, rules, urls
from tests.compare import rows


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|im_sep|>", "<", "|", "\\", "", None, "a\nb", "<<|", "<\\", "é𝄞", "$1 \\1", "x" * 100_000]
    turns = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "assistant", "we<|im_sep|>ird\nrole", "user", None, "<\\n"] * 2, nasty, strict=True))]
    turns += [(2, 5, "assistant", "b"), (2, 1, "assistant", "a"), (2, 5, "assistant", "b"), (2, None, "system", "s"), (None, 0, "user", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("pieces", F.lit("mine"))
    out = chat.format_chats(df).select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.learned(F.col("formatted"), F.col("mask")).alias("learned")).collect()
    assert len(out) == 3
    for r in out:
        own = sorted([t for t in turns if t[0] == r.conv_id], key=lambda t: (t[1] is not None, t[1] or 0, (t[2] or "").encode(), (t[3] or "").encode()))
        assert [(x.role, x.text) for x in r.turns] == [(t[2] or "", t[3] or "") for t in own]
        assert r.learned == "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert r.formatted == "".join(p.text for p in r.pieces)
        own_bytes = r.formatted.encode()
        assert [own_bytes[m.start : m.start + m.size].decode() for m in r.mask] == [p.text for p in r.pieces if p.loss]
    two = next(r for r in out if r.conv_id == 2)
    assert two.formatted.count("<|im_start|>") == 2  # three assistant turns are one block
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_chat(spark):
    turns = [(1, i, "assistant" if i % 3 else "user", f"é{i}<|") for i in range(3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df).select(chat.learned(F.col("formatted"), F.col("mask")).alias("learned")).first()
    assert r.learned == "".join(t[3] for t in turns if t[2] == "assistant")


def test_url_rules(spark):
    cases = [
        ("https://Example.COM/en/7x?q", "example.com", "/en/7x", "example.com/en/7", "allow"), ("http://a.example.com/en/8#t", "a.example.com", "/en/8", "com/en/", "block"), ("http://net/de/", "net", "/de/", "net/de/", "allow"),
        ("x://m.example.net/de/8", "m.example.net", "/de/8", "example.net/de/8", "block"), ("http://badnet/de/", "badnet", "/de/", None, None), ("http://a.org?/es/", "a.org", "", None, None), ("http://a.org/ES/", "a.org", "/ES/", None, None),
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no-scheme.com/en/", "", "", None, None), ("http:///casino-poker/xxx-pills", "", "/casino-poker/xxx-pills", None, "block"), ("a://b://c/d", "b:", "//c/d", None, None), ("https://www.best-pills.example.com/fr/3", "www.best-pills.example.com", "/fr/3", None, "block"),
        ("http://casino-bonus.example.org/fr/9\n", "casino-bonus.example.org", "/fr/9\n", None, "block"), ("https://museum.example.org/fr/9", "museum.example.org", "/fr/9", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit("mine"))
    got = {r.page_id: r for r in urls.judge(df, keep=["page_id", "host"]).collect()}
    for i, (_u, host, path, rule, verdict) in enumerate(cases):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert verdict in (None, r.verdict), r
        assert r.in_host == "mine"
    model = {r.page_id: r.score for r in got.values()}
    assert all(r.verdict == ("block" if model[i] >= 0.5 else "allow") for i, r in got.items() if r.rule is None)
    assert urls.judge(df.select("page_id", "url").limit(0)).count() == 0


def test_urls_of_unseen_hosts(spark):
    """Accuracy on hosts that training didn't see: compounds of its words in another form."""
    seen = [(f"https://shop.{a}-{b}.test/x/{i}", 1) for i, (a, b) in enumerate(zip(urls.UNWANTED, urls.UNWANTED[7:], strict=False))]
    seen += [(f"https://shop.{a}-{b}.test/x/{i}", 0) for i, (a, b) in enumerate(zip(urls.WANTED, urls.WANTED[7:], strict=False))]
    df = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(seen)], "page_id long, url string, y int")
    got = urls.judge(df, keep=["page_id", "y"]).toPandas()
    assert ((got.verdict == "block") == (got.y == 1)).mean() > 0.9


def test_url_scores_by_hand(spark):
    w, bias = urls.train(spark)
    df = spark.createDataFrame([("www.spam-farm.example.com", "/en/12")], "h string, p string")
    f = df.select(urls.features(F.col("h"), F.col("p"), urls.DIMENSIONS).alias("f")).first().f
    z = bias + sum(w[k] for k in f) / len(f) ** 0.5
    got = urls.judge(spark.createDataFrame([(1, "http://www.spam-farm.example.com/en/12")], "page_id long, url string")).first()
    assert abs(got.score - 1 / (1 + 2.718281828459045 ** -z)) < 1e-9 and w == urls.train(spark)[0]


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_rules(spark):
    texts = [None, "", " \n", "a\nb\na\n\na \nb", "x# y|z <é>" * 9, "a b c d e f g h " * 5, "As " * 50, "a b c d e f g h i " + "q " + "a b c d e f g h i", "w " * 50_000, " ".join(map(str, range(300))), "é𝄞 " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit(7))
    labels = spark.createDataFrame([(9, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        for r in rules.apply_rules(df, lab, keep=["doc_id", "score"]).collect():
            want = base(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert not (r.base_failed and r.kept) and r.in_score == 7
    assert rules.apply_rules(df.limit(0), labels).count() == 0


def test_kept_against_plain_counts(spark):
    """Scores and verdicts against multinomials counted in Python over hashes that Spark makes one by one."""
    import math
    import random

    rnd = random.Random(4)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    texts = {i: " ".join(rnd.choice(good if i % 3 else bad) for _ in range(25 + i % 9)) for i in range(150)} | {150: "short", 151: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(0, 100, 2)] + [(None, 1)], "doc_id long, quality int")
    n = rules.bucket_count(len(texts))
    trusted = [i for i in range(0, 100, 2) if i % 3]
    half = {r.i: r.h for r in spark.createDataFrame([(i,) for i in trusted], "i long").selectExpr("i", "pmod(xxhash64(i), 2) h").collect()}
    grams = {}
    for i, t in texts.items():
        w = t.split()
        grams[i] = [(x,) for x in w] + list(zip(w, w[1:], strict=False))
    every = sorted({g for v in grams.values() for g in v})
    one = spark.createDataFrame([(k, g[0], g[-1], len(g)) for k, g in enumerate(every)], "k int, a string, z string, n int")
    place = {every[r.k]: r.b for r in one.selectExpr("k", f"pmod(case when n = 1 then xxhash64(a) else xxhash64(xxhash64(a), xxhash64(z)) end, {n}) b").collect()}
    raw, fit = [1] * n, [1] * n
    for i, v in grams.items():
        for g in v:
            raw[place[g]] += 1
            fit[place[g]] += half.get(i) == 0
    ratio = [math.log(f / sum(fit)) - math.log(r / sum(raw)) for f, r in zip(fit, raw, strict=True)]
    score = {i: sum(ratio[place[g]] for g in v) / len(v) if v else 0.0 for i, v in grams.items()}
    held = sorted(score[i] for i in trusted if half[i] == 1)
    at = 0.005 * (len(held) - 1)
    least = held[int(at)] + (at % 1) * (held[int(at) + 1] - held[int(at)])
    got = rules.apply_rules(docs, labels).collect()
    assert len(got) == len(texts) and 0 < sum(r.kept for r in got) < 152
    for r in got:
        assert abs(r.score - score[r.doc_id]) < 1e-4
        failed = base(texts[r.doc_id])[0] < 20 or 100 * base(texts[r.doc_id])[4] > 30 * base(texts[r.doc_id])[0]
        assert r.kept == (not failed and score[r.doc_id] >= least - 1e-4) or abs(score[r.doc_id] - least) < 1e-3


def test_targets(spark):
    def fill(sizes):
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        cap = {s: 3.0 * n for s, n in sizes.items()}
        full: dict = {}
        while True:
            left = sum(sizes.values()) - sum(full.values())
            open_ = [s for s in order if s not in full]
            total = sum(weight[s] for s in open_)
            t = {s: left * weight[s] / total for s in open_}
            over = [s for s in open_ if t[s] > cap[s]]
            if not over:
                return full | t
            full |= {s: cap[s] for s in over}

    for sizes in ({"a": 100, "b": 5, None: 40, "c": 900}, {"x": 10}, {"a": 1, "b": 1, "c": 1, "d": 10_000}, {"a": 0, "b": 7}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixture.targets(df).collect()}
        want = fill(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes), (got, want)


def test_mixture(spark):
    docs = [(i, " ".join(["w"] * (i % 13)), f"s{i % 4}" if i % 5 else None) for i in range(400)] + [(7, None, "s1"), (None, "a b", "s2"), *[(None, "n " * (i % 7), "s1") for i in range(60)], (3, "q q", "s3"), (3, "q q", "s3"), (900, "z " * 40_000, "s0")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("taken", F.lit("mine"))
    a = mixture.mix(df, keep=["doc_id", "source", "taken"]).toPandas()
    assert len(a) == len(docs) and set(a.in_taken) == {"mine"}
    assert (a.taken >= 0).all() and (a.taken <= 3 * a["size"]).all()
    for _, g in a.groupby("source", dropna=False):
        assert g["size"].sum() == g.source_size.iloc[0] and abs(g.taken.sum() - int(g.target.iloc[0])) == 0
    b = mixture.mix(df.repartition(7), keep=["doc_id", "source", "taken", "text"]).toPandas()
    assert rows(a) == rows(b.drop(columns="text"))
    assert mixture.mix(df.limit(0)).count() == 0


def test_fixity(spark):
    own = [(i * 100, f"d{i}") for i in range(5000)]
    replica = [(o, "bad" if i in (3, 4999) else d) for i, (o, d) in enumerate(own) if i not in (17, 2000)] + [(50, "new"), (None, "x")]
    a, b = (spark.createDataFrame(x, "offset long, digest string") for x in (own, replica))
    want = {300: "corrupt", 499900: "corrupt", 1700: "missing", 200000: "missing", 50: "extra"}
    assert {r.offset: r.status for r in fixity.audit(a, b, leaf_bytes=1000, fanout=4).collect()} == want
    assert fixity.audit(a, a.repartition(3)).count() == 0
    assert fixity.audit(a.limit(0), a.limit(0)).count() == 0
    assert fixity.audit(a, b.limit(0)).count() == 5000


def test_fixity_of_moved_null_and_repeated_records(spark):
    def found(x, y):
        frames = [spark.createDataFrame(v, "offset long, digest string") for v in (x, y)]
        got = fixity.audit(*frames, leaf_bytes=1000, fanout=4).collect()
        assert len(got) == len({r.offset for r in got})
        return {r.offset: r.status for r in got}

    own = [(0, "aa"), (100, "bb"), (200, "cc")]
    assert found(own, [(0, "aa"), (150, "bb"), (250, "cc")]) == {100: "missing", 200: "missing", 150: "extra", 250: "extra"}
    assert found(own, [*own, (300, None)]) == {300: "extra"}
    assert found([*own, (300, None)], [*own, (300, None)]) == {}
    assert found([*own, (300, None)], [*own, (300, "dd")]) == {300: "corrupt"}
    assert found(own, [*own, (200, "cc")]) == {200: "corrupt"}
    assert found([*own, (200, "x")], [*own, (200, "y")]) == {200: "corrupt"}


def test_archive_offsets(spark):
    pages = spark.createDataFrame([(3, "u", "x"), (1, None, None), (None, "http://a", "é"), (3, "u", "x"), (2, "b", "y" * 200_000)], "page_id long, url string, html string").withColumn("offset", F.lit(1))
    m = fixity.manifest(fixity.store(pages)).orderBy("seq").collect()
    assert [r.record_id for r in m] == [None, 1, 2, 3, 3]
    assert [r.offset for r in m] == [sum(x.length for x in m[:i]) for i in range(5)]
    first = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:1>\r\nWARC-Target-URI: \r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert m[1].digest == hashlib.sha256(first.encode()).hexdigest() and m[1].length == len(first)
    assert fixity.manifest(fixity.store(pages.limit(0))).count() == 0


def test_queries_against_sql(spark, sf, duck):
    q, sql = queries.queries(), queries.oracle_sql()
    for name in sql:
        assert rows(q[name](spark, sf).toPandas()) == rows(duck.sql(sql[name]).df()), name
