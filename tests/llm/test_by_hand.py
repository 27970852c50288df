"""Licence scan, URL filter and language kernel against plain versions; main text on foreign layouts."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import regex

from civiccases.llm import html_extract, language_id, licenses, url_filter


# --- licences ----------------------------------------------------------------------------

def plain_canonical(text: str) -> str:
    out = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower())
    for a, b in licenses.SPELLINGS:
        out = regex.sub(rf"\b{a}\b", b, out)
    return out.strip()


def states_copyright(line: str) -> bool:
    return regex.match(r"[^\p{L}\p{N}©]*(copyright\s*(\(c\)|©|[0-9])|\(c\)\s*[0-9]|©).*", line.lower()) is not None


def scan_by_hand(rows: list[tuple], known: list[tuple[str, str]]) -> Counter:
    table = {}
    for lic, text in sorted(known, reverse=True):
        canon = plain_canonical("\n".join(x for x in text.split("\n") if not states_copyright(x)))
        if canon:
            table[canon] = lic
    out = Counter()
    for i, text in rows:
        lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        whole = plain_canonical("\n".join(x for x in lines if not states_copyright(x)))
        if whole in table:
            out[i, "text", None, table[whole]] += 1
        for k, line in enumerate(lines):
            words = plain_canonical(line).split()
            ends = [" ".join(words)] if not states_copyright(line) else {
                " ".join(words[-n:]) for n in {len(t.split()) for t in table} if n <= len(words)}
            for end in ends:
                if end in table:
                    out[i, "line", k + 1, table[end]] += 1
    return out


def test_licenses_of_the_table_by_hand(spark, docs):
    known = licenses.known_texts()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rng = random.Random(2)
    noise = lambda t: "".join(rng.choice([c, c.upper(), c]) for c in t).replace(",", rng.choice([",", " ;"])).replace(" ", rng.choice([" ", "  "]))
    short = [(lic, t) for lic, t in known if len(t) < 3000]
    rows += [(1000 + k, rng.choice(["", "Copyright (c) 1999 Me\n\n", "Some words\n"]) + noise(t)) for k, (_, t) in enumerate(rng.sample(short, 40))]
    found = Counter((r["doc_id"], r["unit"], r["line"], r["license_id"]) for r in licenses.license_table(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3), known).collect())
    assert found == scan_by_hand(rows, known) and sum(k[1] == "text" for k in found) >= 20


# --- URL filter ----------------------------------------------------------------------------

def judged_by_hand(pages: list[tuple]) -> dict:
    """page -> (host, path, rule, verdict or None where trust and distrust are too close to call)."""
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts, links = {}, Counter()
    seeds = {"allow": Counter(), "block": Counter()}
    for i, url, html in pages:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = regex.match(r"[^/?#]*", rest)[0]
        path = regex.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(lower)
        fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        verdict, rule = max(fits)[1:] if fits else (None, None)
        parts[i] = (host, path, rule, verdict)
        if verdict and host:
            seeds[verdict][host] += 1
        for target in regex.findall(r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)", html or ""):
            if host and target.translate(lower) != host:
                links[host, target.translate(lower)] += 1
    hosts = sorted({p[0] for p in parts.values() if p[0]} | {x for e in links for x in e})
    at = {h: k for k, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in links.items():
        w[at[a], at[b]] = n
    w = np.divide(w, w.sum(axis=1, keepdims=True), out=np.zeros_like(w), where=w.sum(axis=1, keepdims=True) > 0)
    back = np.divide(w.T, w.T.sum(axis=1, keepdims=True), out=np.zeros_like(w), where=w.T.sum(axis=1, keepdims=True) > 0)

    def rank(flow, seed):
        s = np.array([seed[h] for h in hosts], float)
        if not s.sum():
            return s
        s, r = s / s.sum(), s / s.sum()
        for _ in range(300):
            moved = r @ flow
            r = s * (0.15 + 0.85 * (1 - moved.sum())) + 0.85 * moved
        return r
    trust, distrust = rank(w, seeds["allow"]), rank(back, seeds["block"])

    def by_ranks(host):
        t, d = (trust[at[host]], distrust[at[host]]) if host in at else (0.0, 0.0)
        return None if 0 < abs(d - t) < 1e-5 else "block" if d > t else "allow"
    return {i: (h, p, r, v or by_ranks(h)) for i, (h, p, r, v) in parts.items()}


def check_pages(spark, pages: list[tuple]) -> None:
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    want = judged_by_hand(pages)
    for r in url_filter.judge_urls(df).collect():
        host, path, rule, verdict = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict or verdict is None, r


def test_urls_of_the_table_by_hand(spark):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    check_pages(spark, pages)


def test_urls_of_a_linked_web_by_hand(spark):
    rng = random.Random(8)
    hosts = [f"h{k}.{rng.choice(['net', 'org', 'com', 'example.org', 'COM'])}" for k in range(30)]
    path = lambda: rng.choice(["", "/", "/de/x", "/fr/y?z", "/es/", "/en/1/a", "/en/2#f", "?de", "#"])
    link = lambda: f'<a {rng.choice(["href", "HREF "])}={rng.choice(list(chr(34) + chr(39)) + [""])}{rng.choice(["http:", "https:", ""])}//{rng.choice(hosts)}{path()}>'
    pages = [(k, f"http://{rng.choice(hosts)}{path()}", " ".join(link() for _ in range(rng.randint(0, 4)))) for k in range(150)]
    check_pages(spark, [*pages, (900, None, link()), (901, "no scheme", None), (902, "http:///x", link())])


# --- language ------------------------------------------------------------------------------

def test_kernel_and_ridge_by_hand():
    """Presence kernel over shared n-grams, Nystroem features and a weighted ridge with intercept, computed densely."""
    rng = random.Random(4)
    lexicon = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(60)]
               for k, letters in (("a", "abcdefgh"), ("b", "efghijkl"), ("c", "klmnopqr"))}
    text = lambda k: " ".join(rng.choice(lexicon[k]) for _ in range(rng.randint(5, 30)))
    rows = [(k, text(k)) for k in "abc" for _ in range({"a": 40, "b": 12, "c": 25}[k])]
    model = language_id.fit(rows, landmarks=8, ridge=0.01)
    sets = [set(language_id.grams(t).tolist()) for _, t in rows]
    seen = defaultdict(int)
    chosen = []
    for j, (k, _) in enumerate(rows):
        if seen[k] < 8:
            chosen.append(j)
        seen[k] += 1
    like = lambda x, y: len(x & y) / np.sqrt(len(x) * len(y))
    k_mm = np.array([[like(sets[i], sets[j]) for j in chosen] for i in chosen])
    k_nm = np.array([[like(s, sets[j]) for j in chosen] for s in sets])
    values, vectors = np.linalg.eigh(k_mm)
    use = values > 1e-6 * values.max()
    feature = vectors[:, use] / np.sqrt(values[use])
    z, y = k_nm @ feature, np.array([[float(k == c) for c in "abc"] for k, _ in rows])
    weight = np.array([1 / (3 * seen[k]) for k, _ in rows])[:, None]
    mz, my = (weight * z).sum(0), (weight * y).sum(0)
    w = np.linalg.solve((z - mz).T @ (weight * (z - mz)) + 0.01 * np.eye(z.shape[1]), (z - mz).T @ (weight * (y - my)))
    for k in "abc":
        for _ in range(10):
            t = text(k)
            own = set(language_id.grams(t).tolist())
            want = (np.array([like(own, sets[j]) for j in chosen]) @ feature - mz) @ w + my
            assert np.allclose(model.outputs(language_id.grams(t)), want, atol=2e-4)
            assert model.predict([t])[0] == ["abc"[want.argmax()]]


# --- main text -------------------------------------------------------------------------------

def layouts(paragraphs: list[str], other: list[str]) -> list[str]:
    """Pages of one article in markup that the tables do not have."""
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    small = "".join(f"<li><a href='#'>{' '.join(o.split()[:3])}</a></li>" for o in other)
    note = "".join(f"<div class='comment'><b>user</b><p>{' '.join(o.split()[:12])}</p></div>" for o in other)
    return [
        f"<html><body><div id='page'><div class='site-header'><ul class='menu'>{small}</ul></div><div class='entry-content'>{body}</div>"
        f"<div class='widget-area sidebar'><h3>Recent</h3><ul>{small}</ul></div><div class='site-footer'>Copyright</div></div></body></html>",
        f"<html><body><table><tr><td colspan=2><a href='/'>Home</a> | <a href='/a'>About</a></td></tr><tr><td class='nav'><ul>{small}</ul></td>"
        f"<td class='content'>{body}</td></tr><tr><td colspan=2 class='footer'>imprint</td></tr></table></body></html>",
        f"<html><body><header class='l-header'><nav class='c-nav'><ul>{small}</ul></nav></header><div class='l-main'><div class='c-post__body'>{body}</div>"
        f"<div class='c-comments'>{note}</div></div><footer class='l-footer'>legal</footer></body></html>",
        f"<html><body><div class='sidebar toc'><ul>{small}</ul></div><div role='main' class='document'><div class='body'>{body}</div></div>"
        f"<div class='cookie-banner'><p>We use cookies to make the site work.</p><button>Accept</button></div></body></html>",
        f"<html><body><div class='topbar'><form class='search'><input><button>Go</button></form></div><section class='story'>{body}</section>"
        f"<section class='related'><h2>More</h2><ul>{small}</ul></section><section class='discussion'>{note}</section></body></html>",
        f"<html><body><div class='ad'><p>Buy now and save.</p></div><article>{body}<div class='share'><a href='#'>Share</a></div></article>"
        f"<aside><ul>{small}</ul></aside><p hidden=''>{other[0]}</p><div style='display: none'><p>{other[1]}</p></div></body></html>",
    ]


def test_foreign_layouts(spark):
    """Word F1 of the extracted text against the article, over six layouts and several articles."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").limit(250).collect()
    trees = html_extract.fit([r["html"] for r in pages[:140]])
    texts = [" ".join(regex.sub(r"<[^>]+>", " ", p).split()) for r in pages[140:] for p in regex.findall(r"<p>(.*?)</p>", r["html"])]
    texts = [t for t in texts if len(t.split()) >= 12 and "&" not in t][:80]
    scores = defaultdict(list)
    for k in range(0, len(texts) - 8, 8):
        for j, page in enumerate(layouts(texts[k:k + 4], texts[k + 4:k + 8])):
            got = Counter(html_extract.extract([page], trees)[0].split())
            want = Counter(" ".join(texts[k:k + 4]).split())
            scores[j].append(2 * (got & want).total() / max(1, got.total() + want.total()))
    means = {j: float(np.mean(s)) for j, s in scores.items()}
    assert len(means) == 6 and min(means.values()) >= 0.95, means
