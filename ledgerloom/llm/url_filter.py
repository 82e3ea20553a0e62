"""URL filters: host and path rules, then a character language-model ratio. DataFrame functions only.

Rules name a host and a path prefix; a rule fits its host and all subdomains if the url's path starts with the rule's,
and the longest fitting rule decides. Urls without a rule are judged by two smoothed variable-order Markov models, one
of accepted and one of rejected urls: a character's probability given up to `ORDER` characters before it, with
Witten-Bell backing off to shorter contexts. The verdict compares the mean log-likelihood difference per character
with a threshold calibrated on the training urls (where the two classes' scores are equally many deviations away).

The urls that rules decide are the training data: allowed ones are accepted, blocked ones rejected. Characters are
folded to `CLASSES` = 43 classes, so there are at most 43**3 = 79,507 contexts, whatever the input. The model is an
array of a context's 43 log ratios each (28 MB in all at most), which is always broadcast: no character is shuffled.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule and is judged on the empty
string; an empty string scores 0; without training urls of both classes every score is null and the verdict is allow;
a score at the threshold is allow; repeated and null ids are judged row by row; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 3
#: What folded urls are made of; every other character is folded to the last one.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./:?=&_#%+@!,^-~"
CLASSES = len(ALPHABET)


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract. Fixed values.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def first_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, null without one. The earlier rule wins among equals."""
    out = (F.lit(None).cast("string"), F.lit(None).cast("string"))
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = (F.when(fits, rule.text).otherwise(out[0]), F.when(fits, rule.verdict).otherwise(out[1]))
    return out


def folded(host: Column, path: Column) -> Column:
    """Host and path in lower case, each digit as 0, each character out of the alphabet as ~."""
    text = F.translate(F.lower(F.concat(host, path)), "123456789", "000000000")
    return F.regexp_replace(text, r"[^a-z0./:?=&_#%+@!,^-]", "~")


def grams(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """One row for each character of the text: (keep..., ctx = the ORDER characters before it, c)."""
    padded = F.concat(F.lit("^" * ORDER), text)
    cut = df.select(*keep, padded.alias("_t")).where(F.length("_t") > ORDER)
    cut = cut.select(*keep, "_t", F.explode(F.sequence(F.lit(1), F.length("_t") - ORDER)).alias("_i"))
    return cut.select(*keep, F.expr(f"substring(_t, _i, {ORDER})").alias("ctx"), F.expr(f"substring(_t, _i + {ORDER}, 1)").alias("c"))


def ratio_table(counts: DataFrame) -> DataFrame:
    """(ctx, llr) from (ctx, c, na, nr): for each character of the alphabet, log P(c | ctx) of the accepted less that of the
    rejected model; null for those that never follow the context.

    Order by order from the shortest context: P(c|ctx) = (n(ctx c) + T(ctx) P(c|shorter)) / (n(ctx) + T(ctx)), where T
    is the number of different characters seen after ctx; a context never seen passes on the shorter one's value.
    """
    model = None
    for k in range(ORDER + 1):
        own = counts.groupBy(F.substring("ctx", ORDER - k + 1, k).alias("ctx"), "c").agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
        sums = own.groupBy("ctx").agg(*(f.alias(x) for n in ("na", "nr") for f, x in ((F.sum(n), f"s_{n}"), (F.sum((F.col(n) > 0).cast("long")), f"t_{n}"))))
        at = own.join(sums, "ctx")
        if model is None:
            at = at.withColumns({"pa": F.lit(1.0 / CLASSES), "pr": F.lit(1.0 / CLASSES)})
        else:
            shorter = model.select(F.col("ctx").alias("_s"), F.col("c").alias("_c"), "pa", "pr")
            at = at.join(shorter, (F.substring("ctx", 2, k - 1) == F.col("_s")) & (F.col("c") == F.col("_c"))).drop("_s", "_c")
        p = {x: F.when(F.col(f"s_n{x[1]}") > 0, (F.col(f"n{x[1]}") + F.col(f"t_n{x[1]}") * F.col(x)) / (F.col(f"s_n{x[1]}") + F.col(f"t_n{x[1]}"))).otherwise(F.col(x)) for x in ("pa", "pr")}
        model = at.select("ctx", "c", "na", "nr", p["pa"].alias("pa"), p["pr"].alias("pr"))
        model = stored(model, f"url-order{k}") if k == ORDER else model
    each = [F.max(F.when(F.col("c") == c, F.log("pa") - F.log("pr"))) for c in ALPHABET]
    return model.groupBy("ctx").agg(F.array(*each).alias("llr"))


def score_urls(parts: DataFrame, llr: DataFrame, key: str) -> DataFrame:
    """(key, score): mean ratio per character. Partial sums are taken where the url was exploded."""
    rows = grams(parts, F.col("folded"), key).join(F.broadcast(llr), "ctx")
    return rows.groupBy(key).agg(F.round(F.avg(F.get("llr", F.instr(F.lit(ALPHABET), F.col("c")) - 1)), 9).alias("score"))


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score) for each row."""
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, ruled = first_rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "ruled": ruled, "folded": folded(F.col("host"), F.col("path"))})
    texts = parts.where(F.length("folded") > 0).groupBy("folded").agg(F.sum((F.col("ruled") == "allow").cast("long")).alias("na"), F.sum((F.col("ruled") == "block").cast("long")).alias("nr"))
    texts = stored(texts.select("folded", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nr", F.lit(0)).alias("nr")), "url-texts")
    counts = grams(texts, F.col("folded"), "na", "nr").groupBy("ctx", "c").agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
    scored = stored(score_urls(texts, ratio_table(stored(counts, "url-grams")), "folded").join(texts, "folded"), "url-scores")
    stats = scored.agg(*(f.alias(n + k) for k, w in (("a", "na"), ("r", "nr")) for n, f in (("n", F.sum(w)), ("s", F.sum(F.col("score") * F.col(w))), ("q", F.sum(F.col("score") * F.col("score") * F.col(w)))))).first()  # one row
    threshold = calibrated(stats)
    free = F.lit("allow") if threshold is None else F.when(F.coalesce("score", F.lit(0.0)) >= threshold, "allow").otherwise("block")
    score = F.lit(None).cast("double") if threshold is None else F.coalesce("score", F.lit(0.0))
    out = parts.join(scored.select("folded", "score"), "folded", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", free).alias("verdict"), score.alias("score"))


def calibrated(stats) -> float | None:
    """Where both classes' scores are equally many standard deviations away; null without both classes."""
    if not stats["na"] or not stats["nr"]:
        return None
    mean = {k: stats["s" + k] / stats["n" + k] for k in "ar"}
    sd = {k: max(stats["q" + k] / stats["n" + k] - mean[k] ** 2, 1e-12) ** 0.5 for k in "ar"}
    return round((mean["a"] * sd["r"] + mean["r"] * sd["a"]) / (sd["a"] + sd["r"]), 9)


__all__ = ["RULES", "Rule", "filter_urls", "first_rule", "split_url"]
