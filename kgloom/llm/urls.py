"""Operator 7: URL verdicts by rules, and by the likelihood ratio of two character models, in DataFrame functions only.

Rules (host, path prefix) hold for a host and its subdomains; the longest decides. URLs that rules allow or block train two
variable-order Markov models of characters: a character's probability after up to three others is its count there,
smoothed by ``WEIGHT`` counts of its probability after one character fewer, down to uniform. A URL that no rule fits gets
the mean over its characters of the two models' log-likelihood difference, each at the longest context that either model
has seen with that character. The threshold is calibrated on the ruled URLs: it lies between the classes' means, at the
same number of standard deviations from both.

Nulls: a null URL, or one without ``://``, has an empty host and path; no rule fits it. Without URLs of both classes
to train on, the method allows. Repeated rows give a row each. Empty tables give no row. Extra columns are ignored. A model
is broadcast if it has at most ``BROADCAST_GRAMS`` grams and joined by shuffle beyond.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import stored

ORDER = 3
WEIGHT = 4.0
#: Size of the alphabet that the models are uniform over when they know nothing.
ALPHABET = 128
BROADCAST_GRAMS = 100_000
#: Characters that a task scores, about; URLs that more than this part of the rows have join as a broadcast.
TASK_CHARACTERS, HOT_URLS = 200_000, 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # "allow" or "block"
    text: str  # host, then the path prefix from its first slash on

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


# The rules of the query.
RULES = (UrlRule("block", "com/en/"), UrlRule("allow", "example.com/en/7"), UrlRule("allow", "net/de/"), UrlRule("block", "example.net/de/8"), UrlRule("block", "org/es/"))


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(rest(url), "^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits the columns ``host`` and ``path``, as a struct of its text and verdict; null for none."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        best = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def _places(urls: DataFrame) -> DataFrame:
    """A row for each character, with the gram of each order that ends in it. ``url`` is the URL between ``^`` and ``$``."""
    at = F.explode(F.sequence(F.lit(2), F.length("url"))).alias("at")
    grams = [F.when(F.col("at") > k, F.substring(F.col("url"), F.col("at") - k, F.lit(k + 1))).alias(f"g{k}") for k in range(ORDER + 1)]
    return urls.select(*urls.columns, at).select(*(c for c in urls.columns if c != "url"), *grams)


def train(urls: DataFrame) -> list[DataFrame]:
    """For each order a table ``gram, ratio`` of the log-likelihood difference, from ``url, allow`` rows."""
    places = _places(urls)
    each = places.select("allow", F.explode(F.array(*(F.col(f"g{k}") for k in range(ORDER + 1)))).alias("gram")).where("gram is not null")
    counts = stored(each.groupBy("gram").agg(F.count_if("allow").alias("a"), F.count_if(~F.col("allow")).alias("r")), "grams")
    models, lower = [], None
    for k in range(ORDER + 1):
        own = counts.where(F.length("gram") == k + 1).withColumn("context", F.substring("gram", 1, k))
        totals = own.groupBy("context").agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
        own = own.join(totals, "context")
        if lower is None:
            own = own.withColumn("la", F.lit(1 / ALPHABET)).withColumn("lr", F.lit(1 / ALPHABET))
        else:
            own = own.withColumn("shorter", F.substring("gram", 2, k)).join(lower.select(F.col("gram").alias("shorter"), F.col("pa").alias("la"), F.col("pr").alias("lr")), "shorter")
        own = own.withColumn("pa", (F.col("a") + WEIGHT * F.col("la")) / (F.col("ta") + WEIGHT)).withColumn("pr", (F.col("r") + WEIGHT * F.col("lr")) / (F.col("tr") + WEIGHT))
        lower = stored(own.select("gram", "pa", "pr"), f"order{k}")
        models.append(lower.select("gram", (F.log("pa") - F.log("pr")).alias("ratio")))
    return models


def scored(urls: DataFrame, models: list[DataFrame]) -> DataFrame:
    """``id, score`` of ``id, url`` rows with an unique id: the mean ratio over the characters, to nine places."""
    characters = urls.agg(F.sum(F.length("url"))).first()[0] or 0
    found = _places(urls.repartition(characters // TASK_CHARACTERS + 1))  # before each becomes as many rows as it has characters
    for k, model in enumerate(models):
        own = model.select(F.col("gram").alias(f"g{k}"), F.col("ratio").alias(f"r{k}"))
        found = found.join(F.broadcast(own) if model.count() <= BROADCAST_GRAMS else own, f"g{k}", "left")
    longest = F.coalesce(*(F.col(f"r{k}") for k in reversed(range(len(models)))), F.lit(0.0))
    return found.groupBy("id").agg(F.round(F.sum(F.round(longest, 12).cast("decimal(24,12)")).cast("double") / F.count("*"), 9).alias("score"))


def judged(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row; ``score`` is null where a rule decides."""
    split = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path")).withColumn("fit", fitting_rule(rules))
    whole = F.concat(F.lit("^"), F.col("host"), F.col("path"), F.lit("$"))
    # equal host and path get equal scores: score each once
    distinct = stored(split.groupBy("host", "path").agg(F.first("fit").alias("fit"), F.count("*").alias("n")), "urls")
    ruled = distinct.where("fit is not null").select(whole.alias("url"), (F.col("fit.verdict") == "allow").alias("allow"))
    models = train(ruled)
    keyed = distinct.select(F.struct("host", "path").alias("id"), whole.alias("url"))
    scores = stored(scored(keyed, models).select("id.host", "id.path", "score"), "scores")
    cut = threshold(scores.join(distinct.where("fit is not null").select("host", "path", "fit"), ["host", "path"]))
    # a hot URL (all null ones are one) is scored once and looked up by broadcast; the others meet by shuffle
    total = split.count()
    scores = stored(scores.join(distinct.select("host", "path", "n"), ["host", "path"]), "scores")
    hot = scores.where(F.col("n") * HOT_URLS > total).drop("n")  # fewer than HOT_URLS
    rest = scores.where(F.col("n") * HOT_URLS <= total).drop("n")
    joined = split.join(F.broadcast(hot), ["host", "path"]).unionByName(split.join(F.broadcast(hot.select("host", "path")), ["host", "path"], "left_anti").join(rest, ["host", "path"]))
    own = F.col("fit.verdict")
    method = F.lit("allow") if cut is None else F.when(F.col("score") >= cut, "allow").otherwise("block")
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(own, method).alias("verdict"), F.when(own.isNull(), F.col("score")).alias("score"))


def threshold(ruled: DataFrame) -> float | None:
    """Equally many standard deviations from the mean scores of both classes; None without both."""
    allow = F.col("fit.verdict") == "allow"
    stats = [x for c in (allow, ~allow) for x in (F.avg(F.when(c, F.col("score"))), F.stddev_pop(F.when(c, F.col("score"))))]
    ma, sa, mr, sr = ruled.agg(*(x.alias(f"x{i}") for i, x in enumerate(stats))).first()
    if ma is None or mr is None:
        return None
    return round((ma * sr + mr * sa) / (sa + sr) if sa + sr > 0 else (ma + mr) / 2, 9)


def _oracle() -> str:
    rows = ", ".join(f"('{r.host}', '{r.path}', '{r.text}', '{r.verdict}')" for r in RULES)
    orders = []
    for k in range(ORDER + 1):
        below = f"join m{k - 1} b on b.gram = substr(c.gram, 2)" if k else ""
        la, lr = ("b.pa", "b.pr") if k else (str(1 / ALPHABET), str(1 / ALPHABET))
        orders.append(f"""m{k} as (
  select c.gram, (c.a + {WEIGHT} * {la}) / (t.ta + {WEIGHT}) as pa, (c.r + {WEIGHT} * {lr}) / (t.tr + {WEIGHT}) as pr
  from counts c join (select substr(gram, 1, {k}) as context, sum(a) as ta, sum(r) as tr from counts where length(gram) = {k + 1} group by 1) t
    on t.context = substr(c.gram, 1, {k}) {below}
  where length(c.gram) = {k + 1}
)""")
    grams = " union all ".join(f"select allow, substr(url, i - {k}, {k + 1}) as gram from places where i > {k} and allow is not null" for k in range(ORDER + 1))
    joins = " ".join(f"left join m{k} on p.i > {k} and m{k}.gram = substr(p.url, p.i - {k}, {k + 1})" for k in range(ORDER + 1))
    longest = "coalesce(" + ", ".join(f"ln(m{k}.pa) - ln(m{k}.pr)" for k in reversed(range(ORDER + 1))) + ", 0.0)"
    return f"""
with rules(rhost, rpath, rule, verdict) as (values {rows}),
rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest
), fits as (
  select host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as fit
  from (select distinct host, path from split) s left join rules r
    on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by host, path
), urls as (
  select host, path, rule, fit, '^' || host || path || '$' as url, fit = 'allow' as allow from fits
), places as (
  select host, path, fit, allow, url, unnest(range(2, length(url) + 1)) as i from urls
), grams as ({grams}
), counts as (
  select gram, count(*) filter (allow) as a, count(*) filter (not allow) as r from grams group by gram
), {", ".join(orders)},
scores as (
  select host, path, fit, round(cast(sum(cast(round({longest}, 12) as decimal(24, 12))) as double) / count(*), 9) as score
  from places p {joins} group by host, path, fit
), stats as (
  select avg(score) filter (fit = 'allow') as ma, stddev_pop(score) filter (fit = 'allow') as sa,
         avg(score) filter (fit = 'block') as mr, stddev_pop(score) filter (fit = 'block') as sr from scores
), cut as (
  select round(case when sa + sr > 0 then (ma * sr + mr * sa) / (sa + sr) else (ma + mr) / 2 end, 9) as cut from stats
)
select s.page_id, s.host, s.path, u.rule,
       coalesce(u.fit, case when cut is null or c.score >= cut then 'allow' else 'block' end) as verdict,
       case when u.fit is null then c.score end as score
from split s join urls u on s.host = u.host and s.path = u.path
join scores c on s.host = c.host and s.path = c.path cross join cut
"""


ORACLE_SQL = _oracle()
