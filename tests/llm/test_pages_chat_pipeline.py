"""Operators on pages and conversations, the pipeline's stages, and the plans of the native operators."""

from __future__ import annotations

import html
import json
import random
import re

import pytest

import corpus_pipeline
from civiccases.llm import chat, html_extract, queries, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


def article(page: str) -> str:
    """The blocks of the one article of a test page."""
    inner = page[page.index("<article>") + 9:page.index("</article>")]
    inner = re.sub(r"</?(p|h1)\b[^>]*>", "\x01", inner).replace("<br>", " ")
    blocks = html.unescape(re.sub(r"<[^>]+>", "", inner)).split("\x01")
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def test_main_text(spark, pages):
    found = {r["page_id"]: r for r in html_extract.main_text_table(pages).collect()}
    rows = pages.collect()
    assert sum(found[r["page_id"]]["text"] == article(r["html"]) for r in rows) >= 0.98 * len(rows)
    odd = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 1), (2, "u", "", 1), (3, "u", "<<<>><p", 1),
                                 (None, "u", "<div>" * 3000 + "x", 1), (4, "u", "<script>a</p>", 1)],
                                "page_id long, url string, html string, text int").unionByName(
        pages.limit(30).selectExpr("page_id + 100 as page_id", "url", "html", "1 as text"))
    got = html_extract.main_text_table(odd).collect()
    assert len(got) == 36 and {r["text"] for r in got if r["page_id"] in (1, 2, 4)} == {""}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.main_text_table(pages.limit(0)).count() == 0


def test_other_markup(pages):
    trees = html_extract.fit([r["html"] for r in pages.limit(120).collect()])
    text = "Here is a paragraph of the story that goes on for quite a few words, as they do."
    page = (f'<body><div class="topbar"><a href=/>Home</a></div><div id="content"><h1>A title</h1><p>{text}</p>'
            f'<p>{text} Again &amp; again.</p></div><div class="comments"><p>{text}</p></div>'
            f'<aside><p>{text}</p></aside><div class="cookie-notice">We use cookies</div><footer>end</footer></body>')
    assert html_extract.extract([page], trees) == [f"A title\n{text}\n{text} Again & again."]


def test_decoding_is_consistent():
    import numpy as np
    parent = np.array([-1, 0, 1, 1, 0])
    keep = html_extract.decode(np.array([0, -3.0, 5.0, -1.0, 2.0]), parent, np.zeros(5))
    assert keep.tolist() == [True, True, True, False, True]
    keep = html_extract.decode(np.array([0, -6.0, 2.0, -1.0, 2.0]), parent, np.zeros(5))
    assert keep.tolist() == [True, False, False, False, True]


def test_url_rules(spark, pages):
    urls = ["https://Example.ORG/es/x?q", "http://a.example.org/en/12#f", "http://b.org", "ftp://b.org/?x", None, "b.org/x",
            "http://x.com/fr/1", "http://y.com/de/1", "http://y.com/other", "http://net/a/b", "http://badorg/x"]
    df = spark.createDataFrame([(k, u, None, "x") for k, u in enumerate(urls)],
                               "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df.drop("host")).collect()}
    assert got == {0: ("example.org", "/es/x", "example.org/es/", "block"), 1: ("a.example.org", "/en/12", "example.org/en/1", "block"),
                   2: ("b.org", "", None, "allow"), 3: ("b.org", "/", "org/", "allow"), 4: ("", "", None, "allow"),
                   5: ("", "", None, "allow"), 6: ("x.com", "/fr/1", "com/fr/", "allow"), 7: ("y.com", "/de/1", "com/de/", "block"),
                   8: ("y.com", "/other", None, "block"), 9: ("net", "/a/b", None, "allow"), 10: ("badorg", "/x", None, "allow")}
    assert url_filter.judge_urls(df).count() == len(urls)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_trust_and_distrust_flow(spark):
    """good -> friend -> next, and spam links to a blocked host; ranks equal a plain iteration."""
    rows = [(1, "http://good.org/x", '<a href="http://friend.net/">'), (2, "http://friend.net/", "<a href='//next.net/y'>"),
            (3, "http://spam.net/", '<a href=http://evil.com/de/1>'), (4, "http://evil.com/de/1", ""), (5, "http://next.net/", None)]
    got = {r["host"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[h]["verdict"] for h in ("friend.net", "next.net", "spam.net", "evil.com")] == ["allow", "allow", "block", "block"]
    trust = {"good.org": 1.0, "friend.net": 0.0, "next.net": 0.0}
    for _ in range(200):
        lost = trust["next.net"]
        trust = {"good.org": 0.15 + 0.85 * lost, "friend.net": 0.85 * trust["good.org"], "next.net": 0.85 * trust["friend.net"]}
    assert all(abs(got[h]["trust"] - t) < 0.01 for h, t in trust.items())


def test_distrust_reaches_the_head_of_a_long_chain(spark):
    """36 hosts, each linking to the next, the last to a blocked one: all get distrust; a bound that is hit is an error."""
    n, before = 36, spark.conf.get("spark.sql.shuffle.partitions")
    seeds = spark.createDataFrame([(f"h{n}", 0.0, 1.0)], "host string, trust double, distrust double")
    edges = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 1.0) for k in range(n)], "src string, dst string, weight double")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r["host"]: r for r in url_filter.propagate(seeds, edges.coalesce(1), tolerance=1e-3).collect()}
        assert len(got) == n + 1 and all(r["distrust"] > r["trust"] == 0 for r in got.values())
        with pytest.raises(RuntimeError, match="after 2 rounds"):
            url_filter.propagate(seeds, edges, max_rounds=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_chat_links_and_order(spark):
    call = {"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "x", "limit": 3}},
                           {"id": "b", "name": "search", "arguments": {"limit": "q"}}, {"id": "c", "name": "no", "arguments": {}}]}
    rows = [(1, 0, "user", 'hi "q"\né'), (1, 1, "assistant", json.dumps(call)), (1, 0, "tool", '{"tool_call_id":"a","content":{"z":1,"a":[1, 2]}}'),
            (1, 3, "tool", '{"tool_call_id":"nope"}'), (1, 4, None, None), (1, 5, "user", "{broken"), (None, None, "user", ""),
            (1, 6, "assistant", '{"tool_calls":7}'), (1, 6, "assistant", '{"tool_calls":7}')]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, calls int")
    got = [r for r in chat.linked_messages(df).collect() if r["conv_id"] == 1]
    got.sort(key=lambda r: (r["order_turn"], r["order_step"], r["turn"]))
    assert [r["role"] for r in got[:4]] == ["user", "assistant", "tool", "tool"]
    assert (got[1]["n_calls"], got[1]["n_answered"], got[1]["call_error"]) == (3, 1, "query is missing")
    assert [r["linked"] for r in got] == [None, None, True, False, None, None, None, None]
    assert json.loads(got[1]["json"]) == {"content": call, "role": "assistant"}
    assert got[2]["json"] == '{"content":{"content":{"a":[1,2],"z":1},"tool_call_id":"a"},"role":"tool"}'
    assert json.loads(got[0]["json"])["content"] == 'hi "q"\né' and json.loads(got[4]["json"]) == {"content": None, "role": None}
    assert len(got) == 8 and chat.linked_messages(df.limit(0)).count() == 0


def test_stages(spark, odd_docs, no_docs):
    """Every stage on odd rows and on none; all but the last return the columns of documents."""
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0
        out = stage(spark, odd_docs.select(*base), SF)
        if name != "packed":
            assert out.columns == base
        kept[name] = [r["doc_id"] for r in out.collect()]
    assert not {3, 4, 5, 8} & set(kept["language"])
    ids = [i for i in kept["near_duplicates"] if i is not None]
    assert len(ids) == len(set(ids)) and 1 in ids and not {2, 7, 10} & set(ids)
    assert sorted(map(str, kept["decontaminated"])) == sorted(str(r["doc_id"]) for r in odd_docs.collect())


@pytest.mark.parametrize("n", [0, 1, 2, 4, 20])
def test_language_stage_follows_the_number_of_languages(spark, n):
    """Short clean documents stay with any number of languages, noise and another script go; unlabelled rows all stay."""
    rng = random.Random(n)
    langs = range(max(n, 1))
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(60)] for k in langs}
    rows = [(j * 100 + k, " ".join(rng.choices(words[k], k=40)), f"l{k}" if n else None) for k in langs for j in range(60)]
    rows += [(10_000 + k, " ".join(words[k][:6]), None) for k in langs]
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(300))
    rows += [(20_003, noise, None), (20_000, "γειά σου κόσμε, τι κάνεις", None), (20_001, "12 -- 34", None), (20_002, None, None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert got == {i for i, _, _ in rows if i < 20_000 or (i in (20_000, 20_003) and n < 2)}


def test_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:3] == ["doc_id", "piece", "start"] and 0 < got.select("doc_id").distinct().count() <= 200


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_decontamination", "op4_fingerprints", "op6_chat_format", "op10_url_filter"])
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
