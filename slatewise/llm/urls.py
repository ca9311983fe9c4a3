"""URL rules and empirical-Bayes host reputation, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.llm.common import keep, sent

#: (verdict, host, path) as they are given.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labels that make a two-label suffix under a country code, and suffixes under which anybody has a name.
SECOND_LEVEL = ("ac", "asn", "co", "com", "csiro", "ed", "edu", "firm", "gen", "go", "gob", "gouv", "gov", "govt", "id", "ind", "info", "lg", "ltd", "me", "mil", "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "police", "res", "sch", "web")
SHARED = ("appspot.com", "azurewebsites.net", "blogspot.com", "cloudfront.net", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "s3.amazonaws.com", "vercel.app", "web.app", "wordpress.com")
ADDRESS = r"^(\d{1,3}\.){3}\d{1,3}$|^\["
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without ``://``. Only A-Z are lower-cased."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def registered(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a url's host part: user and port don't count, nor a final dot. The suffix is one of SHARED, else two labels under a
    country code whose second is one of SECOND_LEVEL, else the last label; the domain has one label more. An address is its own domain and suffix."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(\.?)(:\d*)?$", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    last, second = F.try_element_at(labels, F.lit(-1)), F.try_element_at(labels, F.lit(-2))
    tail = lambda k: F.concat_ws(".", F.slice(labels, F.greatest(n - k + F.lit(1), F.lit(1)), F.least(n, k)))
    wide = (F.length(last) == 2) & F.coalesce(second.isin(*SECOND_LEVEL), F.lit(False))
    take = F.when(tail(F.lit(3)).isin(*SHARED), 3).when(tail(F.lit(2)).isin(*SHARED) | wide, 2).otherwise(1)
    address = name.rlike(ADDRESS)
    return F.when(address, name).otherwise(tail(take + F.lit(1))), F.when(address, name).otherwise(tail(take))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or above it and whose path starts the url's; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # longer ones wrap the shorter
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _strengths(levels: DataFrame) -> DataFrame:
    """(level, m): prior strength of each level of ``levels`` (level, n, k, p): moments of a beta-binomial over its groups around the pooled rate p.
    The intra-group correlation is held in [0.001, 0.5]; without spread to measure it is 0.05."""
    off = F.col("k") / F.col("n") - F.col("p")
    s = levels.where("n > 0").groupBy("level").agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * off * off).alias("ss"), F.max("p").alias("p"))
    v = F.col("p") * (1 - F.col("p"))
    free = F.col("n") - F.col("nn") / F.col("n") - (F.col("g") - 1)
    rho = F.when((v > 0) & (free > 0), F.least(F.greatest((F.col("ss") / v - (F.col("g") - 1)) / free, F.lit(0.001)), F.lit(0.5))).otherwise(F.lit(0.05))
    return s.select("level", (1 / rho - 1).alias("m"))


def host_reputation(outcomes: DataFrame, z: float = 1.0) -> DataFrame:
    """Posterior of a bad page for each host of ``outcomes`` (host, bad 0/1 or null for unlabelled).

    Labelled counts shrink down a ladder of beta-binomial priors: all pages, suffix, registered domain,
    host. Each level's mean is the next one's prior mean; each level's strength comes from moments.
    Returns a kept table of host, n, k, mean, bound (mean less z posterior deviations) and pooled, the rate of all pages. A host without labels has
    its domain's posterior mean; with no labels at all the mean is 0. Pages are counted once; the ladder is worked out on the kept counts of hosts."""
    domain, suffix = registered(F.col("host"))
    hosts = keep(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k")).withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = keep(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = keep(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    p = suffixes.select((F.coalesce(F.sum("k"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("p")).scalar()
    level = lambda df, name: df.select(F.lit(name).alias("level"), "n", "k")
    m = keep(_strengths(level(suffixes, "s").unionByName(level(domains, "d")).unionByName(level(hosts, "h")).withColumn("p", p)), "strengths")
    of = lambda name: F.coalesce(m.where(F.col("level") == name).select("m").scalar(), F.lit(19.0))
    shrunk = lambda m, mean: (m * mean + F.col("k")) / (m + F.col("n"))
    s = suffixes.select("suffix", shrunk(of("s"), p).alias("suffix_mean"))
    d = domains.join(s, "suffix").select("domain", "suffix", shrunk(of("d"), F.col("suffix_mean")).alias("domain_mean"))
    h = hosts.join(d, ["domain", "suffix"]).withColumn("m", of("h"))
    mean = shrunk(F.col("m"), F.col("domain_mean"))
    return keep(h.select("host", "n", "k", mean.alias("mean"), (mean - z * F.sqrt(mean * (1 - mean) / (F.col("m") + F.col("n") + 1))).alias("bound"), p.alias("pooled")), "reputation")


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float | None = None, z: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's labelled pages n, bad ones k, posterior mean and bound for each row of ``pages`` (page_id, url).

    ``outcomes`` (page_id, bad) labels some pages; a repeated id counts as bad if any of its rows is.
    A rule decides where one fits; elsewhere a page is blocked when the lower posterior bound of its
    host's share of bad pages passes ``threshold``, by default the rate of all labelled pages: the host is worse than
    the average page for all that its sample leaves open. Null urls have empty host and path and share the
    reputation of the empty host; a null page_id is never labelled; repeated rows are judged each; without labels nothing is blocked but by rules."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    scores = host_reputation(urls.select("page_id", "host").join(labels, "page_id", "left").select("host", "bad"), z)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = urls.join(sent(scores), "host", "left")
    learned = F.when(F.col("bound") > (F.col("pooled") if threshold is None else F.lit(threshold)), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "n", "k", F.round("mean", 6).alias("mean"), F.round("bound", 6).alias("bound"))


def bad_page() -> Column:
    """1 where a label says poor or toxic, 0 where it says neither, null without a label (quality, toxic)."""
    return F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)


def judge_sql(z: float = 1.0) -> str:
    """The same verdicts in DuckDB, from the labels table by page_id = doc_id."""
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    case = lambda what: "case " + " ".join(f"when {fits(h, p)} then '{what(k, h, p)}'" for k, h, p in longest) + " end"
    among = lambda values: "(" + ", ".join(f"'{x}'" for x in values) + ")"
    tail = lambda n: f"array_to_string(l[greatest(len(l) - ({n}) + 1, 1):], '.')"
    take = f"case when {tail(3)} in {among(SHARED)} then 3 when {tail(2)} in {among(SHARED)} or (length(l[-1]) = 2 and coalesce(l[-2] in {among(SECOND_LEVEL)}, false)) then 2 else 1 end"
    strength = lambda t: f"""(select coalesce(max(1 / (case when v > 0 and free > 0 then least(greatest((ss / v - (g - 1)) / free, 0.001), 0.5) else 0.05 end) - 1), 19)
        from (select p * (1 - p) v, n - nn / n - (g - 1) free, ss, g from (select count(*) g, sum(n) n, sum(n * n) nn, sum(n * (k / n - p) * (k / n - p)) ss, max(p) p from {t}, pooled where n > 0) where g > 0))"""  # noqa: E731
    return f"""
    with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
    v as (select page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') raw, coalesce(rest, '') rest from u),
    urls as (select page_id, translate(raw, '{UPPER}', '{LOWER}') host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') path from v),
    marked as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) bad from labels where doc_id is not null and (quality is not null or toxic is not null) group by doc_id),
    counted as (select host, count(bad) n, coalesce(sum(bad), 0) k from urls left join marked on page_id = doc_id group by host),
    named as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), '(\\.?)(:\\d*)?$', '') as nm, string_split(nm, '.') l, {take} take, regexp_matches(nm, '{ADDRESS}') addr from counted),
    hosts as (select host, n, k, case when addr then nm else {tail("take + 1")} end as domain, case when addr then nm else {tail("take")} end as suffix from named),
    domains as (select domain, suffix, sum(n) n, sum(k) k from hosts group by all),
    suffixes as (select suffix, sum(n) n, sum(k) k from domains group by all),
    pooled as (select coalesce(sum(k), 0) / greatest(coalesce(sum(n), 0), 1) p from suffixes),
    s as (select suffix, ({strength('suffixes')} * p + k) / ({strength('suffixes')} + n) mean from suffixes, pooled),
    d as (select domain, suffix, ({strength('domains')} * mean + k) / ({strength('domains')} + n) mean from domains join s using (suffix)),
    h as (select host, n, k, m, (m * mean + k) / (m + n) mean from hosts join d using (domain, suffix), (select {strength('hosts')} m)),
    b as (select host, n, k, mean, mean - {z} * sqrt(mean * (1 - mean) / (m + n + 1)) bound from h)
    select page_id, host, path, {case(lambda k, h, p: h + p)} rule, coalesce({case(lambda k, h, p: k)}, case when bound > p then 'block' else 'allow' end) verdict, n::bigint n, k::bigint k, round(mean, 6) mean, round(bound, 6) bound
    from urls join b using (host), pooled"""
