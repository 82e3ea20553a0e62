import math
import re
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import url_filter as U


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    best = None
    for verdict, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


def brute(urls):
    parts = [split(u) for u in urls]
    ruled = [rule(*p) for p in parts]
    fold = [re.sub(r"[^a-z0./:?=&_#%+@!,^-]", "~", re.sub("[1-9]", "0", (h + p).lower())) for h, p in parts]
    n = [defaultdict(Counter), defaultdict(Counter)]
    for t, (_, v) in zip(fold, ruled):
        if v:
            s = "^" * U.ORDER + t
            for i in range(U.ORDER, len(s)):
                for k in range(U.ORDER + 1):
                    n[v == "block"][s[i - k : i]][s[i]] += 1

    def p(m, ctx, c):
        low = p(m, ctx[1:], c) if ctx else 1 / 43
        seen = n[m].get(ctx)
        return low if not seen else (seen[c] + len(seen) * low) / (sum(seen.values()) + len(seen))

    def score(t):
        s = "^" * U.ORDER + t
        x = [math.log(p(0, s[i - U.ORDER : i], s[i])) - math.log(p(1, s[i - U.ORDER : i], s[i])) for i in range(U.ORDER, len(s))]
        return sum(x) / len(x) if x else 0.0

    scores = [score(t) for t in fold]
    stat = {}
    for k, verdict in (("a", "allow"), ("r", "block")):
        x = [s for s, t, (_, v) in zip(scores, fold, ruled) if v == verdict and t]
        stat |= {"n" + k: len(x), "s" + k: sum(x), "q" + k: sum(y * y for y in x)}
    cut = U.calibrated(stat)
    return [(h, q, r, v or ("allow" if cut is None or s >= cut else "block"), None if cut is None else s) for (h, q), (r, v), s in zip(parts, ruled, scores)]


ODD = [None, "", "no scheme", "http://", "https://NET/", "http://x.net", "http://x.net/a?b#c", "HTTP://A.Example.NET/en/1", "http://example.net/EN/1", "x://example.com/de/", "x://badexample.com/de/1", "x://a.org/fr/", "x://org/fr/x", "http://a?://b/c", "http://é.org/日本\n/x", "http://a.net:80/"]


def test_urls(spark, sf):
    real = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    for urls in (ODD, real, ODD + real * 3, [None], []):
        df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, folded string")
        got = [tuple(r)[1:] for r in sorted(U.filter_urls(df).collect())]
        want = brute(urls)
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert [g[4] for g in got] == pytest.approx([w[4] for w in want], abs=2e-9)


def test_alphabet_is_what_folding_leaves():
    kept = {re.sub(r"[^a-z0./:?=&_#%+@!,^-]", "~", chr(c)) for c in range(0x3000)}
    assert kept == set(U.ALPHABET) and len(U.ALPHABET) == U.CLASSES == 43


def test_no_python_in_plan(spark, sf):
    plan = U.filter_urls(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(?!Eval)", plan)
