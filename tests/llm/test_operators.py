"""The training-data operators against SQL, plain Python and planted cases."""

from __future__ import annotations

import hashlib
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import SF, assert_same, duck  # noqa: E402

from rasterspark.llm import common, components, decontaminate, html_text, license_scan, line_dedup, minhash_dedup, mixing, ngram_join, quality_model, quality_rules, tool_calls, toxicity  # noqa: E402
from rasterspark.llm.queries import ORACLES, QUERIES  # noqa: E402
from rasterspark.llm.words import LETTERS, SPACED, pieces  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `__doc2` string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs(spark, *texts, **columns):
    rows = [(k, t, columns.get("lang"), columns.get("source"), None, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGE = (None, "", " \n ", "word", "Été ßtraße 123", "long " * 30_000, "same text here and there\nsame text here and there")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], duck())


@pytest.mark.parametrize("run", [line_dedup.dedup_lines, mixing.mix, ngram_join.near_classes, quality_rules.judge, license_scan.scan_licenses], ids=lambda f: f.__name__)
def test_edges_and_empty(spark, run):
    assert run(docs(spark, *EDGE, *EDGE)).count() == 2 * len(EDGE)
    assert run(docs(spark, *EDGE).limit(0)).count() == 0
    twice = docs(spark, "a b c", "a b c").withColumn("doc_id", F.lit(None).cast("long"))
    assert run(twice).count() == 2


@pytest.mark.parametrize("table", [LETTERS, SPACED], ids=["letters", "spaced"])
def test_words(table):
    pattern = WORDS if table is LETTERS else re.compile(r"[^\x20\x09-\x0D]+")
    texts = [*EDGE, "a\x00b c d", "Ab-cD"]
    for piece in pieces(pa.array(texts), table):
        firsts = piece.first_words()
        for d in range(piece.docs):
            text = (texts[piece.first + d] or "").translate(UPPER)
            assert firsts[d + 1] - firsts[d] == len(pattern.findall(text))


def test_line_dedup(spark):
    line = "This Line is long enough to count as a line of 40"
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, *[f"{line}\nown {k}\n  {line.lower()} " for k in range(6)])).collect()}
    assert [out[k].n_dropped for k in range(6)] == [2] * 5 + [0] and out[0].text == "own 0" and out[5].n_lines == 3
    one, many = (line_dedup.dedup_lines(docs(spark, *[f"{line}\nown {k}" for k in range(9)]), batches=b, fanout=2) for b in (1, 5))
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)


def test_line_hash_words_are_independent(spark):
    # with h2 a function of h1, equal first words would have equal second ones: here the first word is made equal
    rows = spark.range(1000).select(F.concat(F.lit("line "), "id").alias("line")).select(line_dedup.line_hash(F.col("line")).alias("h"), F.xxhash64("line").alias("h1"))
    assert rows.where("h.h1 = h1").count() == 1000 and rows.where(F.xxhash64(F.col("h.h1")) == F.col("h.h2")).count() == 0
    chained = spark.range(1000).select(F.concat(F.lit("line "), "id").alias("line")).select(F.xxhash64("line", F.lit(1)).alias("old"), line_dedup.line_hash(F.col("line"))["h2"].alias("h2"))
    assert chained.where("old = h2").count() == 0


def test_line_dedup_edges(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_DOCS", 6)  # both ways of joining the frequent lines
    line, other = "This Line is long enough to count as a line of 40", "Another line that is long enough to be counted here"
    rows = [(k if k else None, f"{line}\n{other if k < 5 else k}\n{line}", None, None, None, "") for k in range(8)] + [(3, None, None, None, None, ""), (3, "", None, None, None, "")]
    data = spark.createDataFrame(rows, DOCS)
    out = line_dedup.dedup_lines(data)
    found = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_lines, r.n_dropped) for r in out.collect())
    assert found == [(-1, 3, 3), (1, 3, 3), (2, 3, 3), (3, 1, 0), (3, 1, 0), (3, 3, 3), (4, 3, 2), (5, 3, 2), (6, 3, 2), (7, 3, 0)]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    very_long = docs(spark, *[f"{line}\n" * 20_000 + f"own {k}" for k in range(5)])
    assert [r.n_dropped for r in line_dedup.dedup_lines(very_long).orderBy("doc_id").collect()] == [20_000] * 4 + [0]


def brute_links(texts, top=4, bottom=5):
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(UPPER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return [[j for j in range(len(sets)) if j != i and sets[i] and sets[j] and bottom * len(sets[i] & sets[j]) >= top * len(sets[i] | sets[j])] for i in range(len(sets))], sets


def test_near_classes(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(30):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 6))):
                copy[int(rng.integers(len(copy)))] = f"x{rng.integers(1000)}"
            texts.append(" ".join(copy))
    big = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    texts += [" ".join(big[:k] + [f"y{k}"] + big[k + 1 :]) for k in range(150)]  # more than a node holds
    links, sets = brute_links(texts)
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        new = [min([root[i], *[root[j] for j in links[i]]]) for i in range(len(texts))]
        if new == root:
            break
        root = new
    out = {r.doc_id: r for r in ngram_join.near_classes(docs(spark, *texts)).collect()}
    assert [out[i].class_id for i in range(len(texts))] == root
    assert [out[i].n_links for i in range(len(texts))] == [len({frozenset(sets[j]) for j in links[i]} - {frozenset(sets[i])}) for i in range(len(texts))]
    assert ngram_join.one_of_each(docs(spark, *texts)).count() == len(set(root))


def test_near_classes_at_a_low_similarity(spark):
    rng, texts = np.random.default_rng(8), []
    for k in range(150):
        base = [f"w{k}x{x}" for x in range(200)]
        texts += [" ".join(base), " ".join(base[:124] + [f"y{k}x{x}" for x in rng.integers(0, 10**6, 76)])]
    links, _ = brute_links(texts, 2, 5)
    assert all(len(x) == 1 for x in links)
    out = {r.doc_id: r for r in ngram_join.near_classes(docs(spark, *texts), similarity=(2, 5)).collect()}
    assert sum(out[2 * k].n_links == out[2 * k + 1].n_links == 1 and out[2 * k + 1].class_id == 2 * k for k in range(150)) == 150
    assert not any(r.n_links for r in ngram_join.near_classes(docs(spark, *texts)).collect())


def test_plan_counts_all_splits():
    for similarity, recall in ((0.8, 0.99999), (0.8, 0.9), (0.4, 0.999), (0.95, 0.99)):
        plan = ngram_join.Plan(similarity, recall)
        for depth in (0, 1, 4):
            runs = plan.runs(1.0, depth)
            assert plan.missed(runs, depth) <= (1 - recall) / 2 + 1e-12 and runs < plan.runs(1.0, depth + 2) + 1
        rng = np.random.default_rng(1)
        agree = rng.binomial(ngram_join.SKETCH, similarity, 20_000)
        assert (agree < plan.least).mean() <= 1 - recall and plan.fringe >= plan.meet >= 0


def test_near_classes_rows_of_one_id_and_of_none(spark):
    a, b = ("one text of more than five words in it " * 4, "another text that has quite other words inside " * 4)
    rows = [(5, a), (3, a), (5, b), (7, b + "more"), (None, a), (None, b), (None, "lonely words without any likeness to others"), (9, None)]
    data = spark.createDataFrame([(d, t, None, None, None, "") for d, t in rows], DOCS)
    out = sorted((str(r.doc_id), str(r.class_id), r.n_copies) for r in ngram_join.near_classes(data).collect())
    assert out == sorted([("5", "3", 3), ("3", "3", 3), ("None", "3", 3), ("5", "5", 2), ("None", "5", 2), ("7", "5", 1), ("None", "None", 1), ("9", "9", 1)])
    left = sorted((str(r.doc_id), r.text) for r in ngram_join.one_of_each(data).collect())
    assert [(d, t) for d, t in left if d in ("3", "5")] == [("3", a), ("5", b)] and len(left) == 4


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    out = {r.node: r.root for r in components.components(edges).collect()}
    assert {out[k] for k in range(41)} == {0} and out[101] == 100


def test_decontamination(spark):
    item = " ".join(f"b{k}" for k in range(30))
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, item), (None, "x y")], "item_id long, text string")
    texts = ["clean words only", f"start {item} end", f"{'pad ' * 900}{' '.join(item.split()[:13])}", "Short, ONE", None, ""]
    out = {r.doc_id: r for r in decontaminate.contamination(docs(spark, *texts), bench).collect()}
    assert [(out[k].n_hit, out[k].n_items, out[k].contaminated) for k in range(6)] == [(0, 0, False), (30, 2, True), (13, 2, False), (2, 1, True), (0, 0, False), (0, 0, False)]
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs(spark, *texts), bench).collect()} == {0, 2, 4, 5}
    assert decontaminate.contamination(docs(spark, *texts), bench.limit(0)).where("contaminated").count() == 0


def test_mixing_follows_the_tree(spark, monkeypatch):
    data = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mix(data).collect()
    assert all(r.taken == sum(d.words for d in r.draws) and len(r.draws) == r.copies for r in out)
    sql = {r[0]: r[5] for r in duck().execute(ORACLES["op6_source_mixing"]).fetchall()}
    assert {r.doc_id: ",".join(str(d.shard) for d in r.draws) for r in out} == sql
    one = lambda quotas, depth, seed: quotas.select(F.lit(0).alias("shard"), "no", "n")
    monkeypatch.setattr(mixing, "split_tree", one)
    assert {r.doc_id: r.shards for r in mixing.query(spark, SF).collect()} != sql


def test_mixing_keeps_columns_of_its_names(spark):
    given = docs(spark, *EDGE, *EDGE, "w " * 50).withColumns({"size": F.lit("mine"), "draws": F.lit(1)})
    out = mixing.mixed_documents(given)
    assert set(given.columns) < set(out.columns) and {"size_", "draws_", "target", "copies", "taken"} < set(out.columns)
    assert {r.size for r in out.collect()} == {"mine"}


def test_decontamination_edges(spark):
    item = " ".join(f"b{k}" for k in range(13))
    bench = spark.createDataFrame([(1, item), (2, f"{item} tail")], "item_id long, text string")
    texts = (*EDGE, f"{item} gap " * 2_000)
    out = {r.doc_id: r for r in decontaminate.contamination(docs(spark, *texts), bench).collect()}
    assert [out[k].n_hit for k in range(len(EDGE))] == [0] * len(EDGE)
    assert (out[len(EDGE)].n_words, out[len(EDGE)].n_hit, out[len(EDGE)].n_items) == (28_000, 26_000, 2)
    assert decontaminate.contamination(docs(spark, *EDGE).limit(0), bench).count() == decontaminate.drop_contaminated(docs(spark, *EDGE).limit(0), bench).count() == 0
    twice = docs(spark, item, "clean").withColumn("doc_id", F.lit(4)).unionByName(docs(spark, item).withColumn("doc_id", F.lit(None).cast("long")))
    assert [r.text for r in decontaminate.drop_contaminated(twice, bench).collect()] == ["clean"]


def test_quality_rules_ties_and_clashes(spark):
    good = " ".join(f"word{k}" for k in range(40))
    rows = [(k, good, "en", "s", None, "") for k in range(130)] + [(200, good + " " + " ".join(f"#{k}###" for k in range(30)), "en", "s", None, ""), (201, good, None, None, None, "")]
    data = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in ("n_words", "kept", "limits", "level", "one", "metric")})
    out = {r.doc_id: r for r in quality_rules.judge(data).collect()}
    assert len(out) == 132 and all(out[k].kept for k in range(130)) and out[201].kept
    assert not out[200].kept and "symbols" in out[200].failed  # equal documents leave no room beside their word length


def test_mixing(spark):
    rows = [(k, "w " * (5 + k % 90), None, f"s{k % 5}" if k % 7 else None, None, "") for k in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df).collect()
    by = {}
    for r in out:
        assert r.taken <= 3 * r.size and len(r.draws) == r.copies
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 1 for t, n in by.values())
    assert sum(t for t, _ in by.values()) == pytest.approx(sum(r.size for r in out))
    assert sorted(map(str, mixing.mix(df.repartition(3)).collect())) == sorted(map(str, out))
    shards = [r.shard for r in mixing.shard_rows(mixing.mix(df)).collect()]
    assert len(shards) == sum(r.copies for r in out) and len(set(shards)) == 8
    tree = mixing.split_tree(spark.createDataFrame([(1, 40), (2, 7), (3, 1)], "no int, n long"), 3, "t").groupBy("no").sum("n").collect()
    assert {r[0]: r[1] for r in tree} == {1: 40, 2: 7, 3: 1}
    draws = spark.range(4000).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(25), mixing.uniform(F.col("id"))).alias("k")).agg(F.avg("k"), F.stddev("k"), F.min("k"), F.max("k")).first()
    assert draws[0] == pytest.approx(10, abs=0.15) and draws[1] == pytest.approx(1.75, abs=0.15)


def test_tool_calls(spark):
    calls = spark.createDataFrame([(1, "a", 0, "t", '{"n":1, "m":"x"}', []), (1, "b", 1, "t", "{", ["a"]), (1, "c", 2, "u", "{}", ["b", "a", "gone"]), (1, "d", 3, "t", '{"n":"x"}', ["e"]), (1, "e", 4, "t", '{"n":500}', ["d"]), (None, None, 5, None, None, None)], "conv_id long, call_id string, seq int, name string, arguments string, parents array<string>")
    results = spark.createDataFrame([(1, "a", "r2"), (1, "a", "r1"), (2, "b", "no")], "conv_id long, call_id string, content string")
    schemas = spark.sql("SELECT 't' AS tool, 'n' AS arg, 'integer' AS type, true AS required, 0.0D AS low, 9.0D AS high")
    out = {r.seq: r for r in tool_calls.link_calls(calls, results, schemas).collect()}
    assert [out[k].level for k in range(6)] == [0, 1, 2, None, None, 0]
    assert [list(out[k].faults) for k in range(6)] == [["unknown:m"], ["json"], ["tool"], ["type:n"], ["range:n"], ["tool"]]
    assert out[0].message == '{"arguments":{"m":"x","n":1},"content":"r1","id":"a","level":0,"name":"t","parents":[]}' and not out[1].linked


def test_tool_call_levels_against_plain_python(spark):
    rng = np.random.default_rng(5)
    calls = [(1, f"c{k}", [f"c{k - 1}"]) for k in range(70)]  # a long chain
    for conv in range(2, 14):
        n = int(rng.integers(2, 30))
        back = 0 if conv % 3 else 2  # some conversations have cycles
        calls += [(conv, f"c{k}", [f"c{int(rng.integers(0, k + back))}" for _ in range(int(rng.integers(0, 3)))] if k else []) for k in range(n)]
    want = {}
    for _ in calls:
        for conv, call, parents in calls:
            ups = [p for p in set(parents) if (conv, p) in {(c, i) for c, i, _ in calls}]
            if all((conv, p) in want for p in ups):
                want[conv, call] = max((want[conv, p] + 1 for p in ups), default=0)
    rows = [(conv, call, k, parents) for k, (conv, call, parents) in enumerate(calls)]
    out = tool_calls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, key long, parents array<string>"))
    assert {rows[r.key][:2]: r.level for r in out.collect()} == want


def test_tool_calls_edges(spark):
    kind = "conv_id long, call_id string, seq int, name string, arguments string, parents array<string>, facts string, key string"
    big = '{"q":"' + "long " * 60_000 + '","deep":[[{"a":null}]],"n":1.5}'
    calls = spark.createDataFrame([(1, "a", 0, "t", big, None, "x", "y"), (1, "a", 1, "t", "[1]", ["a", "a"], "x", "y"), (1, None, 2, "t", "null", [None], "x", "y"), (1, "b", 3, "t", "", [], "x", "y")], kind)
    results = spark.createDataFrame([(1, "a", None), (1, None, "never")], "conv_id long, call_id string, content string")
    schemas = spark.sql("SELECT 't' AS tool, 'q' AS arg, 'string' AS type, true AS required, null AS low, 10.0D AS high UNION ALL SELECT 't', 'n', 'number', false, null, null UNION ALL SELECT 't', 'deep', 'array', false, null, null")
    out = {r.seq: r for r in tool_calls.link_calls(calls, results, schemas).collect()}
    assert [list(out[k].faults) for k in range(4)] == [["range:q"], ["json"], ["json"], ["json"]] and [out[k].linked for k in range(4)] == [True, True, False, False]
    assert '"deep":[[{"a":null}]],"n":1.5,"q":"long ' in out[0].message
    assert tool_calls.link_calls(calls.limit(0), results, schemas).count() == 0
    assert [r.linked for r in tool_calls.link_calls(calls, results.limit(0), schemas).collect()] == [False] * 4


def test_html_frame(spark):
    text = "A plain paragraph of words. " * 10
    rows = [(1, "u", f"<article><p>{text}</p></article>", "mine"), (1, "u", f"<article><p>{text}</p></article>", "mine"), (None, None, None, "mine"), (2, "v", "", "mine"), (3, "w", "<div>" + f"<p>{text}</p>" * 3000 + "</div>", "mine"), (4, "x", "no markup at all", "mine"), (5, "y", "<" * 1000, "mine")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(html_text.extract(pages).collect(), key=lambda r: (r.page_id or 0, r.n_chars))
    one = len(text.strip())
    assert [r.n_chars for r in out if r.page_id != 5] == [0, one, one, 0, 3000 * (one + 2) - 2, len("no markup at all")]
    assert html_text.extract(pages).columns == ["page_id", "url", "text", "n_chars"] and html_text.extract(pages.limit(0)).count() == 0


def plain_line_blocks(lines):
    """The lines of a flat page that stay, by the method's rules written out: lines are texts and whether they are links."""
    plain, links = [0 if a else len(t) for t, a in lines], [len(t) if a else 0 for t, a in lines]
    windows = [range(i, min(i + 3, len(lines))) for i in range(len(lines))]
    most = max(sum(plain[j] for j in w) for w in windows)
    picked = {j for w in windows if 0 < sum(plain[j] for j in w) >= 0.2 * most and sum(plain[j] for j in w) >= sum(links[j] for j in w) for j in w if plain[j]}
    core = [i for i in picked if plain[i] >= 0.2 * most / 3]
    kept = sorted(picked | ({i for i in range(len(lines)) if plain[i]} if core else set()))
    return sorted({*kept, *[k for a, b in zip(kept, kept[1:]) if b - a <= 4 for k in range(a + 1, b)]})


def test_html_against_plain_line_blocks():
    rng = np.random.default_rng(9)
    for _ in range(200):
        lines = [(f"line{k} " + "word " * int(rng.choice([0, 1, 3, 30, 80])) + "end", bool(rng.random() < 0.4)) for k in range(int(rng.integers(2, 25)))]
        if all(a for _, a in lines):
            continue
        page = "<body>" + "".join(f"<p><a href=x>{t}</a></p>" if a else f"<p>{t}</p>" for t, a in lines) + "</body>"
        assert html_text.main_text(page) == "\n\n".join(lines[k][0] for k in plain_line_blocks(lines)), page


def test_html():
    page = '<html><head><title>t</title></head><body><nav><a>m</a></nav><div class="cookie-notice">c</div><article><h1>T&eacute;st</h1><p>one<br>two&nbsp; three</p><div class="ad">buy</div><p>four</article><div id="comments"><p>no</p></div><footer>f</footer><p tru'
    assert html_text.main_text(page) == "Tést\n\none two three\n\nfour"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""
    loose = f"<div>x</div><div><p>{'long text. ' * 30}</p><p>short</p><p>{'more text. ' * 30}</p></div><form>f</form><script>if (a<b) {{}}</script>"
    assert html_text.main_text(loose).split("\n\n")[-2:] == ["short", ("more text. " * 30).strip()]


def test_html_without_marked_article():
    a, b, c = (f"{'A long paragraph of plain text. ' * 12}{k}" for k in "abc")
    cases = {
        f"<div><h1>Head</h1><p>By Line</p><p>Monday</p><p>{a}</p><p>{b}</p><p>{c}</p></div>": ["Head", "By Line", "Monday", a, b, c],
        f"<div><p>{a}</p><p>{b}</p><p><a>1</a></p><p><a>2</a></p><p><a>3</a></p><p>The end.</p></div>": [a, b, "1", "2", "3", "The end."],
        f"<div><p>{a}</p><p><a>All of it linked</a></p><p>{b}</p></div>": [a, "All of it linked", b],
        f"<div><h1>Head</h1><p>{a}</p><p>{b}</p></div><article><p>Read this too</p></article>": ["Head", a, b],
        f'<div class="page has-sidebar"><div class="sidebar">s</div><p>{a}</p><p>{b}</p></div>': [a, b],
        f'<main><article class="post category legal"><p>{a}</p></article></main>': [a],
        f"<form id=f><p>{a}</p></form><footer>{b}</footer>": [a],
        f'<svg class="i"/><article><p>{a}</p></article><div id="comments"><p>{b}</p></div>': [a],
        f"<ul><li><a>Home</a><li><a>About</a></ul><div><p>{a}</p></div>": [a],
    }
    for page, want in cases.items():
        assert html_text.main_text(page).split("\n\n") == want, page


def test_license(spark):
    texts = ["x\nLicensed under the Apache License, Version 2.0.\ny", "Licensed under the Banana License, Version 7.1 of the fruit.", None, "plain"]
    out = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, *texts)).collect()}
    assert [list(out[k].licenses) for k in range(4)] == [["Apache-2.0"], [], [], []]
    assert out[0].blocks[0].line == 1 and out[0].blocks[0].saved > 0 and out[1].blocks[0].license is None and out[1].blocks[0].missing


@pytest.mark.parametrize("width", [4, 7, 1000])
def test_every_license_template_wrapped(width):
    scanner = license_scan.Scanner(license_scan.NOTICES)
    for name, templates in license_scan.NOTICES.items():
        for template in templates:
            words = template.split()
            text = "intro\n" + "\n".join(" * " + " ".join(words[k : k + width]) for k in range(0, len(words), width)) + "\nplain end"
            assert [(x[0], x[2]) for x in scanner.confirmed(text)] == [(1, name)], (name, template)


def brute_licenses(scanner, text):
    """Word ranges and names of all windows with a template's wording, compared with every window of every length."""
    words, out = license_scan.words_of(text), []
    for name, template, _ in scanner.templates:
        n, slack = len(template), int(license_scan.SLACK * len(template))
        for size in range(max(1, n - slack), n + slack + 1):
            for i in range(len(words) - size + 1):
                lost, extra = license_scan.wording(template, words[i : i + size])
                if len(lost) + len(extra) <= slack and words[i] in template and words[i + size - 1] in template:
                    out.append((i, i + size, name))
    return out


def test_licenses_against_every_window():
    notices = {k: license_scan.NOTICES[k][:2] for k in ("GPL-3.0", "LGPL-3.0", "ISC", "CC-BY-4.0", "CC-BY-NC-4.0", "Apache-2.0")}
    scanner, rng = license_scan.Scanner(notices), np.random.default_rng(4)
    for _ in range(12):
        parts = []
        for name in rng.choice(sorted(notices), 3):
            words = notices[name][int(rng.integers(len(notices[name])))].split()
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(len(words)))] = f"x{rng.integers(9)}"
            parts += ["plain prose " * int(rng.integers(0, 4)), " ".join(words)]
        text = "\n".join(parts)
        brute, found = brute_licenses(scanner, text), scanner.confirmed(text)
        assert {x[2] for x in found} <= {name for _, _, name in brute}
        # every stretch that some template's wording covers is confirmed once
        covered = sorted({w for a, b, _ in brute for w in range(a, b)})
        runs = sum(1 for i, w in enumerate(covered) if i == 0 or covered[i - 1] != w - 1)
        assert len(found) >= runs and (not brute or found), text


def test_license_prefilter_loses_nothing(spark):
    texts = [t.replace(" ", sep).upper() if up else t.replace(" ", sep) for texts in license_scan.NOTICES.values() for t in texts for sep, up in ((" ", False), ("\n * ", True))]
    texts += ["x (C) 1999 y", "LICENCE", "licensing", "Redistributed", "WITHOUT WARRANTY", "sold As Is", "SPDX-id", "Public Domain", "All Rights Reserved", "COPYRIGHT"]
    out = docs(spark, *texts, "plain").select("text", license_scan.may_hold(F.lower("text"), license_scan.NOTICES).alias("may")).collect()
    assert all(r.may for r in out[:-1]) and not out[-1].may


def test_license_ties_edges_and_length(spark):
    same = {"B": ("these are the very words of it",), "A": ("these are the very words of it",)}
    text = "x\nthese are the very words of it\ny"
    out = license_scan.scan_licenses(docs(spark, text, text, None, "", "word", f"{text} " * 3000), same).collect()
    assert [list(r.licenses) for r in out] == [["A"], ["A"], [], [], [], ["A"]] and len(out[5].blocks) == 3000
    gpl = license_scan.NOTICES["LGPL-3.0"][0]
    assert [x[2] for x in license_scan.Scanner(license_scan.NOTICES).confirmed(f"{gpl}\nprose\n{license_scan.NOTICES['GPL-3.0'][1]}")] == ["LGPL-3.0", "GPL-3.0"]


def test_licenses_without_cue_and_side_by_side(spark):
    mit, bsd = license_scan.NOTICES["MIT"], license_scan.NOTICES["BSD-3-Clause"][0]
    texts = [f"a\n{mit[1]}\nb", f"{mit[0]}\nLicensed under CC BY 4.0.", f"{mit[0]} Licensed under CC BY 4.0.", f"{mit[0]}\nLicensed under the Banana License.", bsd.replace("forms, ", "forms,\n"), mit[1].replace("hereby ", "now "), mit[1][:90]]
    out = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, *texts)).collect()}
    assert [list(out[k].licenses) for k in range(7)] == [["MIT"], ["CC-BY-4.0", "MIT"], ["CC-BY-4.0", "MIT"], ["MIT"], ["BSD-3-Clause"], ["MIT"], []]
    assert [(b.line, b.license) for b in out[3].blocks] == [(0, "MIT"), (1, None)]
    assert out[5].blocks[0].missing == ["hereby"] and out[5].blocks[0].added == ["now"]


def test_quality_model_on_held_out(spark):
    folder = "/root/testdata/sf0.01"
    out = QUERIES["op8_quality_classifier"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    right, n = out.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert right / n >= 0.9
    assert quality_model.quality_scores(docs(spark, *EDGE), spark.read.parquet(f"{folder}/labels.parquet").limit(0)).count() == len(EDGE)


def test_trees_against_plain_traversal():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 15)).round(2)
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] < -0.4)).astype(float)
    trees = quality_model.fit(x, y)
    scores = trees.score(x)
    for row, score in zip(x[:60], scores, strict=False):
        total = trees.base
        for feature, cut, leaf in zip(trees.feature.tolist(), trees.cut.tolist(), trees.leaf.tolist(), strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)
    assert ((scores >= 0.5) == (y == 1)).mean() > 0.95
    few = quality_model.fit(x[:12], y[:12])
    assert len(few.cut) and len(set(few.score(x[:12]).round(6))) > 1


def test_quality_edges_with_a_trained_model(spark):
    good, bad = "A plain sentence of some words that reads well, with an end. " * 8, "## $$ 12 12 12 ## || "
    rows = [(k, good + str(k) if k % 2 else bad * (k + 3), "en", "s", None, "") for k in range(120)]
    extra = [(900 + k, t, None, None, None, "") for k, t in enumerate((*EDGE, bad * 40_000))]
    data = spark.createDataFrame(rows + 2 * extra + [(None, good, None, None, None, "")], DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)] + [(None, 1), (1, None), (2, 0)], "doc_id long, quality int")
    out = quality_model.quality_scores(data, labels).collect()
    assert len(out) == data.count() and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id < 120)
    assert {r.predicted for r in out if r.doc_id == 900 + len(EDGE)} == {0} and [(r.predicted, r.held_out) for r in out if r.doc_id is None] == [(1, False)]
    assert quality_model.quality_scores(data.limit(0), labels).count() == 0
    assert quality_model.quality_scores(data, labels, max_rows=30).count() == data.count()


def plain_toxicity(chain, text):
    """p_toxic of one text in plain Python, from the chain's marks and weights."""
    words = [w.encode() for w in WORDS.findall((text or "").translate(UPPER))]
    marks = {}
    for piece in pieces(pa.array([text or ""])):
        found = dict(zip([piece.folded[a:b].tobytes() for a, b in zip(piece.word_at, piece.word_end, strict=True)], toxicity.buckets_of(piece.hashes).tolist(), strict=True))
        assert set(found) == set(words)
        marks |= {b: True for b in found.values()}
        for length in toxicity.PREFIXES:
            at, prefix = toxicity.prefix_buckets(piece, length)
            heads = {}
            for i, b in zip(at.tolist(), prefix.tolist(), strict=True):
                heads.setdefault(b, set()).add(piece.word(i))
            marks |= {b: True for b, named in heads.items() if len({found[w.encode()] for w in named}) > 1}
    before = []
    for chosen, weights in chain:
        total = weights[-1] + sum(w for c, w in zip(chosen.tolist(), weights, strict=False) if c in marks) + sum(p * w for p, w in zip(before, weights[len(chosen) :], strict=False))
        before.append(float(toxicity.sigmoid(np.array(total))))
    return before[-1]


def test_toxicity_against_plain_python(spark):
    folder = "/root/testdata/sf0.01"
    data, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    chain = toxicity.train(data, labels)
    out = toxicity.toxicity(data, labels).join(data.select("doc_id", "text"), "doc_id").collect()
    assert len(out) == data.count()
    for r in out:
        assert r.p_toxic == pytest.approx(plain_toxicity(chain, r.text), abs=1e-9), r.doc_id
    kept = {r.doc_id for r in toxicity.drop_toxic(data, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in out if not r.toxic}


def test_toxicity_edges_with_a_trained_chain(spark):
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)] + [(None, 1), (1, None), (3, 0)], "doc_id long, toxic int")
    texts = [f"plain words number{k} here" + (" nasty vile" if k % 3 == 0 else "") for k in range(90)]
    extra = [(900 + k, t, None, None, None, "") for k, t in enumerate((*EDGE, "nasty vile " * 40_000, "nasty vile"))]
    data = spark.createDataFrame([(k, t, "en", "s", None, "") for k, t in enumerate(texts)] + 2 * extra + [(None, "nasty vile", None, None, None, "")], DOCS)
    out = toxicity.toxicity(data, labels)
    toxic = {r.doc_id for r in out.where("toxic").collect()}
    assert out.count() == data.count() and toxic == {*range(0, 90, 3), 900 + len(EDGE), 901 + len(EDGE), None}
    left = toxicity.drop_toxic(data, labels)
    assert left.columns == data.columns and left.count() == data.count() - 30 - 5
    assert toxicity.drop_toxic(data.limit(0), labels).count() == toxicity.toxicity(data.limit(0), labels).count() == 0
    assert toxicity.toxicity(docs(spark, *EDGE), labels.limit(0)).count() == len(EDGE)


def test_toxicity_by_language(spark):
    folder = "/root/testdata/sf0.1"
    data, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    # taught by one half of the labels, held against the other
    out = toxicity.toxicity(data, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("y")), "doc_id")
    rows = out.join(data.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.avg(F.when(F.col("y") == 1, F.col("toxic").cast("int"))), F.avg(F.when(F.col("y") == 0, F.col("toxic").cast("int")))).collect()
    assert {r[0] for r in rows} == {"en", "fr", "de", "es"}
    assert all(recall >= 0.8 and wrong <= 0.01 for _, recall, wrong in rows), rows


def test_toxicity_prefixes():
    piece = next(pieces(pa.array(["stemmed stemming", "stemmed stemmed", "stem"])))
    docs_, buckets = toxicity.marks(piece)
    shared = toxicity.prefix_buckets(piece, 5)[1][0]
    assert docs_[buckets == shared].tolist() == [0]


@pytest.mark.parametrize("form", ["{}", "__{}", "p_{}"])
def test_clashing_columns(spark, form):
    extra = {form.format(c): F.lit(c) for c in ("doc", "Doc_", "hash", "text_hash", "lost", "left", "kept", "words", "toxic", "row")}
    given = docs(spark, *EDGE).withColumns(extra)
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet").limit(0) for t in ("labels", "benchmark"))
    runs = [
        lambda d: toxicity.drop_toxic(d, labels, threshold=2.0),
        lambda d: line_dedup.dedup_lines(d).drop("n_lines", "n_dropped"),
        ngram_join.one_of_each,
        lambda d: decontaminate.drop_contaminated(d, bench),
        lambda d: mixing.mixed_documents(d).select(*d.columns),
    ]
    for run in runs:
        out = run(given)
        assert out.columns == given.columns
        assert out.select(*extra).distinct().collect() == given.select(*extra).limit(1).collect()


def plain_pipeline(spark, folder):
    """The five stages in plain Python over the same trained chain; the mix by its SQL."""
    data, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    chain = toxicity.train(data, labels)
    rows = [r.asDict() for r in data.collect() if plain_toxicity(chain, r.text) < 0.5]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(r["doc_id"])
    for r in rows:
        r["text"] = "\n".join(x for x in (r["text"] or "").split("\n") if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == r["doc_id"])
        r["n_chars"] = len(r["text"])
    links, sets = brute_links([r["text"] for r in rows])
    root = [r["doc_id"] for r in rows]
    prints = {}
    for i, one in enumerate(sets):
        prints.setdefault(frozenset(one) if one else ("none", i), []).append(i)
    for _ in rows:
        new = [min([root[i], *[root[j] for j in links[i]], *[root[j] for j in prints[frozenset(sets[i]) if sets[i] else ("none", i)]]]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    rows = [r for r, x in zip(rows, root, strict=True) if r["doc_id"] == x]
    windows = set()
    for item in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = WORDS.findall((item.text or "").translate(UPPER))
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        w, hit = WORDS.findall(text.translate(UPPER)), set()
        for n in sizes:
            hit |= {p for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
        return not hit or 20 * len(hit) < len(w)

    rows = [r for r in rows if clean(r["text"])]
    con = duck()
    con.register("kept", pa.Table.from_pylist([{"doc_id": r["doc_id"], "text": r["text"], "source": r["source"]} for r in rows]))
    taken = {r[0]: (r[4], r[5]) for r in con.execute(ORACLES["op6_source_mixing"].replace("FROM documents", "FROM kept")).fetchall()}
    out = []
    for r in rows:
        n, shards = taken[r["doc_id"]]
        left, size = n, len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        for shard in filter(None, shards.split(",")):  # whole copies first
            words = min(left, size)
            left -= words
            text = r["text"] if words == size else " ".join(re.findall(r"[^\x20\x09-\x0D]+", r["text"])[:words])
            out.append((r["doc_id"], text, r["n_chars"] if words == size else len(text), words, int(shard)))
    return sorted(out)


def test_pipeline_against_plain_python(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.text, r.n_chars, r.taken, r.shard) for r in out) == plain_pipeline(spark, SF)
    assert len(out) > len({r.doc_id for r in out})  # a document may be drawn several times


def test_pipeline_stages_keep_columns_on_empty_and_clashing_tables(spark):
    import corpus_pipeline

    given = docs(spark, *EDGE, *EDGE).withColumns({c: F.lit("mine") for c in ("size", "draws", "set", "class", "row", "words")})
    for table in (given, given.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, SF).columns == given.columns, name
        assert set(given.columns) < set(corpus_pipeline.STAGES[-1][1](spark, table, SF).columns)
    assert corpus_pipeline.STAGES[0][1](spark, given.limit(0), SF).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    left = list({r.doc_id: r.text for r in sorted(out.collect(), key=lambda r: r.taken)}.values())
    assert left and len({hashlib.sha256(t.encode()).hexdigest() for t in left if t}) == len([t for t in left if t])


def test_license_compression_picks_and_rejects():
    scanner = license_scan.Scanner(license_scan.NOTICES)
    bsd2, bsd3 = license_scan.NOTICES["BSD-2-Clause"][0], license_scan.NOTICES["BSD-3-Clause"][1]
    assert [x[2] for x in scanner.confirmed(bsd2)] == ["BSD-2-Clause"] and [x[2] for x in scanner.confirmed(bsd3)] == ["BSD-3-Clause"]
    words = " ".join(license_scan.words_of(bsd2))
    ranked = scanner.rank(words)
    assert scanner.templates[ranked[0][1]][0] == "BSD-2-Clause" and len(ranked) < len(scanner.templates) / 2
    assert scanner.rank("plain prose about nothing that a notice says") == []
    # a rank that doesn't look at the bytes names another licence, and one that rejects everything names none
    scanner.rank = lambda block: [(100, k) for k in reversed(range(len(scanner.templates)))]
    other = {x[2] for x in scanner.confirmed(bsd2)}
    scanner.rank = lambda block: [(100, k) for k in range(len(scanner.templates))]
    assert other != {"BSD-2-Clause"} or {x[2] for x in scanner.confirmed(bsd2)} != {"BSD-2-Clause"}
    scanner.rank = lambda block: []
    assert scanner.confirmed(bsd2) == []


def test_license_bound_keeps_every_near_wording():
    rng = np.random.default_rng(8)
    scanner = license_scan.Scanner(license_scan.NOTICES)
    for t, (name, template, _) in enumerate(scanner.templates):
        n = int(license_scan.SLACK * len(template))
        for _ in range(12):
            words = list(template)
            for k in rng.choice(len(words), n // 2, replace=False):
                words[int(k)] = f"x{rng.integers(99)}"
            noise = " ".join(f"copyright{rng.integers(9)} prose" for _ in range(int(rng.integers(0, 60))))
            block = f"{noise} {' '.join(words)} {noise}"
            assert t in {k for _, k in scanner.rank(block.strip())}, (name, n)


def test_license_unnamed_block_is_compared_whole():
    short, long = license_scan.NOTICES["Apache-2.0"][0], license_scan.NOTICES["MIT"][1]
    text = "copyright of all\n" * 20 + "Licensed under the Apache Banana, Version 2.0."
    found = license_scan.Scanner({"A": (short,), "B": (long,)}).scan(text)
    assert [(x[2], x[4], x[5]) for x in found] == [(None, ["license"], ["banana"])]


def test_quality_thresholds_follow_the_sketches(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = lambda size, n: " ".join("".join(rng.choice(list("abcdefgh"), int(s))) for s in rng.normal(size, 1, n).clip(2).round())
    rows = [(k, words(4 + 8 * (k % 2), 60) + (" ##" * int(rng.integers(0, 6)) if k % 2 else ""), "ab"[k % 2], None, None, "") for k in range(300)]
    rows += [(1000, words(12, 60), "a", None, None, ""), (1001, words(12, 60), "b", None, None, ""), (1002, words(4, 60) + " ##", "a", None, None, ""), (1003, words(12, 60) + " ##", "b", None, None, "")]
    data = spark.createDataFrame(rows, DOCS)
    out, limits = quality_rules.judged(data)
    out = {r.doc_id: list(r.failed) for r in out.collect()}
    assert out[1000] == ["word_length"] and out[1001] == [] and out[1002] == ["symbols"] and out[1003] == []
    high = {(r.lang, r.metric): r.high for r in limits.where("level = 'lang'").collect()}
    assert high["a", "word_length"] < high["b", "word_length"] and high["a", "symbols"] < high["b", "symbols"]
    # with one sketch of everything in place of the groups' own, other documents are rejected
    monkeypatch.setattr(quality_rules, "BEYOND", 10**6)
    wide = {r.doc_id: list(r.failed) for r in quality_rules.judge(data).collect()}
    assert wide != out and wide[1000] == []


def test_html_asides_stay_out_whatever_their_size():
    article = ("A sentence of the article itself, with several words. " * 6).strip()
    comments = "".join(f"<div class='comment'><p>{'Reader says a lot of things here. ' * 3}{k}</p></div>" for k in range(60))
    boxes = ("div class=comments", "section id=comments", "div class=sidebar", "div class=comments-area", "aside", "div class='post-comments'", "div class='related-posts'", "div class='ad-slot'", "div class='cookie-notice'", "footer")
    for tag in ("article", "div"):
        for box in boxes:
            parts = [f"<{tag}><p>{article}</p></{tag}>", f"<{box}>{comments}</{box.split()[0]}>"]
            for order in (parts, parts[::-1]):
                assert html_text.main_text(f"<html><body>{''.join(order)}</body></html>") == article, (tag, box)
    inside = f"<article><p>{article}</p><div class='comments'>{comments}</div><div class='sidebar'>{comments}</div></article>"
    assert html_text.main_text(inside) == article
    listed = comments.replace("<div class='comment'>", "<article class='comment'>").replace("</div>", "</article>")
    wrapped = f"<div class='site has-sidebar'><header>h</header><article><p>{article}</p></article><div id='comments'>{listed}</div><footer>f</footer></div><p>(c) me</p>"
    assert html_text.main_text(wrapped) == article
    assert html_text.main_text(f"<div class='sidebar'>{comments}</div>") == "" == html_text.main_text(f"<div class='entry comments'>{comments}</div>")
    assert html_text.main_text(f"<div class='entry has-comments'><p>{article}</p></div>") == article


def test_html_windows_decide_inside_an_article():
    article = ("A sentence of the article itself, with several words. " * 6).strip()
    links = "".join(f"<p><a href=x>more of link {k}</a></p>" for k in range(12))
    page = f"<article><p>{article}</p></article><article>{links}</article><div><p>{article} 2</p><p>tiny</p></div>{links}"
    assert html_text.main_text(page).split("\n\n") == [article, f"{article} 2", "tiny"]


def test_html_is_linear_in_nesting():
    import time

    def took(n):
        began = time.perf_counter()
        html_text.main_text("<div>" * n + "<p>some text</p><b>x</i>" * n + "</div></p>" * n)
        return time.perf_counter() - began

    took(500)
    assert took(16_000) < 40 * max(took(1_000), 0.01)


def test_tool_calls_of_repeated_ids_link_in_linear_size(spark, monkeypatch):
    n = 5_000
    calls = [(1, "same", k, []) for k in range(n)] + [(1, "child", n + k, ["same"]) for k in range(n)] + [(1, "last", 2 * n, ["child", "same"]), (1, "loop", 2 * n + 1, ["loop"]), (1, "loop", 2 * n + 2, []), (1, "under", 2 * n + 3, ["loop"])]
    sizes = {}
    real = tool_calls.saved

    def seen(df, name):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(tool_calls, "saved", seen)
    rows = spark.createDataFrame(calls, "conv_id long, call_id string, key long, parents array<string>")
    out = {r.key: r.level for r in tool_calls.levels(rows).collect()}
    assert out == {k: k // n for k in range(2 * n + 1)} | {2 * n + 2: 0}
    assert sizes["call-links"] <= 4 * n


def test_decontamination_filter_comes_as_columns(spark):
    hashes = spark.range(200_000).select(F.xxhash64("id").alias("h"), F.lit(3).alias("k"))
    words, widths = decontaminate.bit_filter(hashes, 200_000)
    place = np.array([r.h for r in hashes.collect()]).view(np.uint64) & np.uint64(64 * len(words) - 1)
    want = np.zeros(len(words), np.uint64)
    np.bitwise_or.at(want, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
    assert (words.view(np.uint64) == want).all() and widths == [3]


def test_mixing_draws_of_many_blocks(spark):
    import math
    import time

    def plain(t, m, d, u):
        ks = range(max(0, d - (t - m)), min(m, d) + 1)
        logs = [-sum(math.lgamma(x + 1) for x in (k, m - k, d - k, t - m - d + k)) for k in ks]
        weights = [math.exp(v - max(logs)) for v in logs]
        cut, total = u * sum(weights), 0.0
        for k, w in zip(ks, weights, strict=True):
            total += w
            if total > cut:
                return k

    rows = [(t, m, d, u) for t, m, d in ((1, 1, 1), (1, 0, 0), (9, 4, 5), (300, 17, 150), (5000, 4000, 2500), (20_000, 10_000, 10_000)) for u in (1e-9, 0.2, 0.5, 0.77, 1 - 1e-9)]
    df = spark.createDataFrame(rows, "t long, m long, d long, u double")
    got = [r.k for r in df.select(mixing.hypergeometric(F.col("t"), F.col("m"), F.col("d"), F.col("u")).alias("k")).collect()]
    assert got == [plain(*r) for r in rows]
    began = time.perf_counter()
    k = spark.createDataFrame([(4_000_000, 1_048_576, 2_000_000)], "t long, m long, d long").select(mixing.hypergeometric(F.col("t"), F.col("m"), F.col("d"), F.lit(0.5)).alias("k")).first().k
    assert abs(k - 524_288) < 2 and time.perf_counter() - began < 20
    spread = docs(spark, *[f"text {k}" for k in range(3000)]).withColumn("doc_id", F.lit(None).cast("long"))
    assert mixing.planned(spread).select("key").distinct().count() == 3000


def test_broadcast_counts_the_hash_table(spark):
    # a row of two numbers takes 16 bytes of values, but over 64 in the driver's hash table
    few, probe = spark.range(9).selectExpr("id AS u", "id AS m"), spark.range(9).withColumnRenamed("id", "u")
    for rows, wanted in ((100_000, "BroadcastHashJoin"), (500_000, "SortMergeJoin")):
        plan = probe.join(common.broadcast_if_small(few, rows), "u")._jdf.queryExecution().sparkPlan().toString()
        assert wanted in plan, rows


@pytest.mark.parametrize("run", [ngram_join.near_classes, minhash_dedup.near_components], ids=lambda f: f.__name__)
def test_joins_without_broadcast(spark, monkeypatch, run):
    base = [" ".join(f"t{g}x{i}" for i in range(80)) for g in range(20)]
    data = docs(spark, *(f"{text} end{k}" if k else text for text in base for k in range(4)), *base, *EDGE)
    whole = sorted(map(tuple, run(data).collect()), key=str)
    filtered, plain = [], common.bit_set
    monkeypatch.setattr(common, "bit_set", lambda *a: filtered.append(1) or plain(*a))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, run(data).collect()), key=str) == whole and filtered


def test_wanted_texts_are_filtered(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = spark.range(20_000).select(F.col("id").alias("doc"), F.xxhash64("id").alias("text_hash"), F.lit("x").alias("text"))
    wanted = common.saved(rows.where("doc % 1000 = 7").select("doc", "text_hash", (F.col("doc") + 1).alias("set")), "wanted")
    joined = common.with_wanted(rows, wanted)
    assert "SortMergeJoin" in joined._jdf.queryExecution().sparkPlan().toString()
    assert sorted(r.set for r in joined.collect()) == list(range(8, 20_000, 1000))
    passed = common.in_bit_set(common.bit_set(wanted.select(F.col("text_hash").alias("h")), 20), np.asarray(rows.select("text_hash").toArrow()["text_hash"]).view(np.uint64))
    assert 20 <= passed.sum() < 60
