import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import linededup, quality_rules, urlfilter
from tessera.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    r = con.execute(ORACLES[name])
    cols = [c[0] for c in r.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    key = lambda x: tuple(map(repr, x))
    assert sorted(map(tuple, got.select(*cols).collect()), key=key) == sorted(r.fetchall(), key=key)


def slow_measures(text):
    t = text or ""
    words, now = [], ""
    for c in t + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words += [now] if now else []
            now = ""
        else:
            now += c
    lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    held = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(held)


@pytest.mark.parametrize("text", [None, "", "a", "a b c d e", "a b c d e f a b c d e", "x " * 12, "l one\nl one\n\n \nl two\nl one ", "## $ a|b <c>", "ü\u00a0x é\x0by", "a b c d e x a b c d e a b c d e"])
def test_measures(docs, text):
    r = quality_rules.judge(docs([(1, text)])).first()
    want = slow_measures(text)
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
    assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_quality_odd_input(odd):
    d = odd.withColumn("n_words", F.lit("clash")).withColumn("__lines", F.lit(0))
    assert [r["__lines"] for r in quality_rules.judge(d).collect()] == [0] * 10
    assert quality_rules.judge(d.limit(0)).count() == 0
    assert not any(r.kept for r in quality_rules.judge(d).where("text is null or text = ''").collect())


URLS = [
    ("http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/12?x=/", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/en/2#f", "example.org", "/en/2", "org/", "allow"),
    ("https://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("https://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("https://x.com/dex", "x.com", "/dex", None, "allow"),
    ("https://org", "org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b.net?q=://c.org/", "b.net", "", None, "allow"),
]


def test_url_rules(spark):
    d = spark.createDataFrame([(i, u[0], "clash", 1) for i, u in enumerate(URLS)], "page_id long, url string, rule string, bad_host int")
    got = urlfilter.judge(d, None).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [u[1:] for u in URLS]
    assert urlfilter.judge(d.limit(0), None).count() == 0


def test_reputation_shrinks_to_the_parents(spark):
    rows = [("good.a.com", 1)] * 60 + [("bad.b.com", 0)] * 50 + [("bad.b.com", 1)] * 2 + [("once.c.com", 0)] + [("new.b.com", None)] + [("good.d.com", 1)] * 40
    d = spark.createDataFrame([(i, f"http://{h}/x", o) for i, (h, o) in enumerate(rows)], "page_id long, url string, o int")
    got = {r.host: r.verdict for r in urlfilter.judge(d, "o", rules=()).select("host", "verdict").distinct().collect()}
    assert got["bad.b.com"] == "block" and got["good.a.com"] == "allow"
    sd = {r.host: r for r in urlfilter.host_reputation(d.groupBy(urlfilter.parts(F.col("url"))[0].alias("host")).agg(F.count(F.when(F.col("o") == 1, 1)).alias("k"), F.count("o").alias("n"))).collect()}
    assert sd["bad.b.com"].good_mean < sd["new.b.com"].good_mean < sd["good.d.com"].good_mean
    assert sd["once.c.com"].good_sd > sd["bad.b.com"].good_sd  # one bad page proves little


def test_suffix_and_domain(spark):
    d = spark.createDataFrame([("a.b.co.uk:80",), ("x.example.com",), ("localhost",), ("",)], "host string")
    got = [tuple(r) for r in d.select(*urlfilter.suffix_and_domain(F.col("host"))).collect()]
    assert got == [("co.uk", "b.co.uk"), ("com", "example.com"), ("localhost", "localhost"), ("", "")]


def slow_line_dedup(rows, run=3, words=50, span=2):
    """Plain winnowing: fingerprints, first places, extension line by line."""
    full, first, marks = {}, {}, {}
    order = lambda r: (r[0] is None, r[0] or 0)
    for r in sorted(set(rows), key=order):
        lines = (r[1] or "").split("\n")
        full[r] = [(i, x.strip(" \t\x0b\x0c\r")) for i, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        text = [x for _, x in full[r]]
        made = []
        for p in range(len(text)):
            for k in range(1, run + 1):
                n = sum(len(x.split()) for x in text[p : p + k])
                if p + k <= len(text) and (k == run or n >= words):
                    made.append((hashlib.md5("\n".join(text[p : p + k]).encode()).hexdigest(), -p, n >= words))
                    break
        chosen = {min(made[j : j + span]) for j in range(max(1, len(made) - span + 1))} if made else set()
        marks[r] = sorted((-w[1], w[0]) for w in chosen | {w for w in made if w[2]})
        for p, mark in marks[r]:
            first.setdefault(mark, (r, p))
    gone = {r: set() for r in full}
    for r, prints in marks.items():
        for p, mark in prints:
            o, q = first[mark]
            if (o, q) == (r, p):
                continue
            a, b = full[r], full[o]
            lo = hi = 0
            while p - lo > 0 and q - lo > 0 and a[p - lo - 1][1] == b[q - lo - 1][1]:
                lo += 1
            while p + hi + 1 < len(a) and q + hi + 1 < len(b) and a[p + hi + 1][1] == b[q + hi + 1][1]:
                hi += 1
            gone[r] |= {a[i][0] for i in range(p - lo, p + hi + 1)}
    out = [(r[0], r[1] if not gone[r] else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone[r])) for r in rows]
    return sorted(out, key=repr)


def test_line_dedup_by_brute_force(docs):
    random.seed(3)
    rows = []
    for i in range(120):
        lines = [random.choice(["alpha", "beta ", "", "gamma", "delta", f"own {i} {k}"]) for k in range(random.randint(0, 14))]
        if i % 3 == 0:
            lines += ["shared one", "shared two", "", "shared three", "shared four"]
        rows.append((i, "\n".join(lines)))
    rows += [(200, rows[0][1]), (200, rows[0][1]), (None, rows[3][1])]
    for more in ({}, {"min_run": 2, "span": 3}, {"min_words": None, "span": 1}):
        got = linededup.dedup_lines(docs(rows), **more).select("doc_id", "text").collect()
        assert sorted(map(tuple, got), key=repr) == slow_line_dedup(rows, more.get("min_run", 3), more.get("min_words", 50) or 10**9, more.get("span", 2))


def test_repeated_runs_are_guaranteed(docs):
    """Each run of four lines, or of 50 words in up to three, that an earlier text holds goes."""
    random.seed(11)
    rows, planted = [], []
    for i in range(60):
        lines = [f"own {i} {k}" for k in range(random.randint(2, 9))]
        rows.append((i, "\n".join(lines)))
    for n, size in ((4, 2), (7, 3), (1, 50), (2, 26), (3, 17)):
        run = [" ".join(f"r{n}l{k}w{j}" for j in range(size)) for k in range(n)]
        for i in random.sample(range(60), 5):
            rows[i] = (i, "\n".join([rows[i][1], *run, f"between {i} {n}"]))
        planted.append("\n".join(run))
    got = dict(linededup.dedup_lines(docs(rows)).select("doc_id", "text").collect())
    for run in planted:
        assert sum(all(x in t.split("\n") for x in run.split("\n")) for t in got.values()) == 1


def test_extension_finds_what_no_fingerprint_marks(docs):
    """A repeated run is longer than its fingerprints: its ends come by extension."""
    run = [f"line {k}" for k in range(12)]
    rows = [(1, "\n".join(["top", *run, "end"])), (2, "\n".join(["other", *run, "more"]))]
    marked = linededup.fingerprints(docs(rows), span=4).where("doc_id = 2").first()
    covered = {x.p + j for x in marked.prints for j in range(3)}
    assert not set(range(1, 13)) <= covered
    got = dict(linededup.dedup_lines(docs(rows), span=4).select("doc_id", "text").collect())
    assert got == {1: rows[0][1], 2: "other\nmore"}


def test_line_dedup_cuts_long_runs_of_few_lines(docs):
    random.seed(5)
    lines = [" ".join(f"l{k}w{j}" for j in range(n)) for k, n in enumerate([1, 5, 20, 24, 25, 26, 30, 49, 50, 51, 90])]
    rows = [(i, "\n".join(random.choice(["", "{} ", " {}", "{}"]).format(random.choice(lines)) if random.random() < 0.6 else f"own {i} {k}" for k in range(random.randint(1, 6)))) for i in range(80)]
    got = linededup.dedup_lines(docs(rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == slow_line_dedup(rows) != slow_line_dedup(rows, words=10**9)


def test_pipeline_cuts_a_long_line(spark, docs):
    import corpus_pipeline

    line = " ".join(f"w{i}" for i in range(60))
    out = corpus_pipeline.dedup_lines(spark, docs([(1, line), (2, f"other\n{line}"), (3, "short\nshort")]), None).collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in out} == {1: (line, len(line)), 2: ("other", 5), 3: ("short\nshort", 11)}


def test_line_dedup_odd_input(odd):
    names = ["Row_key", "row_key_", "found_id", "runs", "all_lines", "keep", "spot", "lines"]
    d = odd.withColumns({n: F.lit(n) for n in names})
    got = linededup.dedup_lines(d, removed_col="n_gone")
    assert all(r[n] == n for r in got.collect() for n in names)
    assert got.columns == [*d.columns, "n_gone"] and got.count() == 10
    assert linededup.dedup_lines(d.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op3_url_filter", "op4_quality_rules", "op9_line_dedup"])
def test_native_plans_hold_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "MapInArrow"))
