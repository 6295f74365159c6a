"""URL filters with trust that runs over a graph of hosts.

Rules judge pages: a rule fits its host, all subdomains, and the paths that start with its own; the longest rule that
fits wins. Pages without a rule go by their host's scores, from personalised PageRank over host edges in Spark:

  trust     starts at hosts by the share of their pages that rules allow, and runs along links;
  distrust  starts at hosts by the share that rules block, and runs against links (who links to a blocked host is suspect);
  reach     starts at hosts by the share that any rule fits, NEUTRAL at least, once along and once against links: how much
            of a score could have come here.

Edges are hyperlinks between hosts, weighed by the pages that hold them, and ties between all hosts of a domain, both
ways, for each domain from the registered one down: a host has weight FAMILY in each of its domains, in equal
shares for all others there. Ties are never made as pairs: a round sums each domain and takes the host's own share off.
A score is (1 - DAMPING) * seed + DAMPING * what the neighbours pass on, each in shares of its weights; after ROUNDS rounds at
most DAMPING ** ROUNDS of the seeds' mass is still under way.

A host's verdict compares distrust and trust in relation to what reached the host, so that it depends neither on how many link
to it nor on how many seeds there are: blocked if distrust / reach against links - trust / reach along links exceeds a cut.
The cut comes from hidden seeds: the same rounds also run without the seeds of a fifth of the hosts (by a hash of the name),
and of the levels of a grid those that find most of these hosts again (recall of those blocked more than allowed, less
the share of falsely blocked) count; the middle one is the cut. Without hidden seeds of both kinds it is CUT.

Hosts, links and domains with many rows are split in joins.

Defined results: a null url, or one without "://", has empty host and path, no rule and verdict allow;
a null html has no links; repeated rows are judged one by one; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import hot_of, join_spread
from .common import ascii_lower, let, lookup, remove, written

DAMPING = 0.85
ROUNDS = 16
#: Weight of a host's ties in one of its domains, as many links.
FAMILY = 1.0
#: Reach that starts at a host without ruled pages: traces of a score from afar don't decide.
NEUTRAL = 0.01
#: Cut without hidden seeds, levels of the grid between -1 and 1, and the part of all hosts that is hidden.
CUT, LEVELS, HIDDEN = 0.5, 64, 5
#: Labels under which countries register domains (example.co.uk), besides the country itself; there is no list of public suffixes at hand.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "or", "org")
LINK = r"""(?i)href\s*=\s*["']?(https?://[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rules_of(lines: Sequence[tuple[str, str]]) -> list[Rule]:
    """("block", "example.com/de/") -> a rule; the host ends at the first slash."""
    return [Rule(text[: text.index("/")], text[text.index("/") :], verdict) for verdict, text in lines]


RULES = rules_of([("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")])


def host_and_path(url: Column) -> Column:
    """struct(host, path)."""
    at = F.instr(url, "://")

    def parts(rest: Column) -> Column:
        host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
        path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
        return F.struct(ascii_lower(host).alias("host"), path.alias("path"))

    nothing = F.struct(F.lit("").alias("host"), F.lit("").alias("path"))
    return F.when(at > 0, let(F.substr(url, at + 3), parts)).otherwise(nothing)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does. Rules are configuration, some thousands at most."""
    out = F
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = out.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict")))
    return out.otherwise(F.lit(None).cast("struct<rule:string,verdict:string>"))


def ruled(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, judged (the rule that fits) and links (hosts, each once) of each page."""
    parsed = pages.select("page_id", "html", host_and_path(F.coalesce("url", F.lit(""))).alias("u")).select("page_id", "html", "u.host", "u.path")
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)), lambda u: host_and_path(u)["host"]))
    there = F.when(F.contains("html", F.lit("://")) & (F.col("host") != ""), F.filter(links, lambda h: (h != "") & (h != F.col("host"))))
    return parsed.select("page_id", "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("judged"), F.coalesce(there, F.expr("cast(array() as array<string>)")).alias("links"))


def link_edges(judged: DataFrame) -> DataFrame:
    """(src, dst, weight) from ruled(): how many pages of src link to dst."""
    linked = judged.filter(F.size("links") > 0).select(F.col("host").alias("src"), F.explode("links").alias("dst"))
    return linked.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def seeds_of(judged: DataFrame) -> DataFrame:
    """(host, trusted, blocked): shares of the host's pages that a rule allows or blocks."""
    share = lambda verdict: F.avg(F.when(F.col("judged.verdict") == verdict, 1.0).otherwise(0.0))
    return judged.filter("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))


def domains(host: Column) -> Column:
    """The domains that hold a host, from itself up to the registered one; an address or a single label is its own."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")

    def up(labels: Column) -> Column:
        n = F.size(labels)
        country = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.greatest(-n, F.lit(-2))).isin(*SECOND_LEVEL)
        last = F.greatest(F.lit(1), n - F.when(country, 2).otherwise(1))
        return F.transform(F.sequence(F.lit(1), last), lambda k: F.array_join(F.slice(labels, k, n), "."))

    return F.when(F.rlike(name, F.lit(r"^[0-9.]+$|^\[|^$")), F.array(name)).otherwise(let(F.split(name, r"\."), up))


#: Scores of a host: by all seeds, and by those that aren't hidden; trust and reach along links, distrust and reach against them.
ALONG, AGAINST = ("trust", "reach", "trust_held", "reach_held"), ("distrust", "back", "distrust_held", "back_held")
SCORES = (*ALONG, *AGAINST)


def hidden(host: Column) -> Column:
    return F.crc32(host.cast("binary")) % HIDDEN == 0


def starts(hosts: DataFrame) -> DataFrame:
    """(host and seeds by score) from hosts (host, trusted, blocked)."""
    open_ = F.when(hidden(F.col("host")), 0.0).otherwise(1.0)
    any_ = F.greatest(F.col("trusted") + F.col("blocked"), F.lit(NEUTRAL))
    held = F.greatest((F.col("trusted") + F.col("blocked")) * open_, F.lit(NEUTRAL))
    seeds = {"trust": F.col("trusted"), "reach": any_, "trust_held": F.col("trusted") * open_, "reach_held": held, "distrust": F.col("blocked"), "back": any_, "distrust_held": F.col("blocked") * open_, "back_held": held}
    return hosts.select("host", *(seeds[c].alias(c) for c in SCORES))


def families(hosts: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """(host, domain, n): the domains of each host that hold n > 1 hosts; and the hot ones among them."""
    held = written(hosts.select("host", F.explode(domains(F.col("host"))).alias("domain")), "host-domains")
    shared = written(held.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "host-shared")
    hot = hot_of(shared, shared.agg(F.sum("n")).first()[0] or 0)
    kin = written(join_spread(held, shared, "domain", hot=hot).select("host", "domain", "n"), "host-families")
    remove(held)
    remove(shared)
    return kin, hot


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, family: float = FAMILY) -> DataFrame:
    """(host, trusted, blocked and SCORES) of all hosts from links (src, dst, weight) and seeds (host, trusted, blocked)."""
    links = written(links, "host-links")
    hosts = seeds.select("host").union(links.select("src")).union(links.select("dst")).distinct()
    own = written(hosts.join(seeds, "host", "left").select("host", F.coalesce("trusted", F.lit(0.0)).alias("trusted"), F.coalesce("blocked", F.lit(0.0)).alias("blocked")), "host-seeds")
    start = written(starts(own), "host-starts")
    kin, hot_domains = families(own.select("host"))
    tie_weights = kin.select("host", F.lit(family).alias("w_out"), F.lit(family).alias("w_in"))
    out_of = links.select(F.col("src").alias("host"), F.col("weight").alias("w_out"), F.lit(0.0).alias("w_in"))
    into = links.select(F.col("dst").alias("host"), F.lit(0.0).alias("w_out"), F.col("weight").alias("w_in"))
    total = written(tie_weights.unionByName(out_of).unionByName(into).groupBy("host").agg(F.sum("w_out").alias("w_out"), F.sum("w_in").alias("w_in")), "host-weights")
    along = links.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.col("weight").alias("along"), F.lit(0.0).alias("against"))
    against = links.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("along"), F.col("weight").alias("against"))
    # What a host passes on of its scores, along and against: to a linked host, and to a domain as a whole.
    share = lambda c, w: F.coalesce(F.col(c) / F.nullif(F.col(w), F.lit(0.0)), F.lit(0.0))
    summed = along.unionByName(against).groupBy("host", "to").agg(F.sum("along").alias("along"), F.sum("against").alias("against"))
    both = written(summed.join(total, "host").select("host", "to", share("along", "w_out").alias("along"), share("against", "w_in").alias("against")), "host-moves")
    ties = written(kin.join(total, "host").select("host", "domain", "n", (family / F.col("w_out")).alias("along"), (family / F.col("w_in")).alias("against")), "host-ties")
    counts = both.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    hubs = hot_of(counts, both.count())
    linked, tied = bool(both.head(1)), bool(kin.head(1))
    state = start
    for _ in range(rounds if linked or tied else 0):
        got = []
        passed = [(F.col(c) * F.col(way)).alias(c) for way, names in (("along", ALONG), ("against", AGAINST)) for c in names]
        if linked:
            got.append(join_spread(both, state, "host", hot=hubs).select(F.col("to").alias("host"), *passed))
        if tied:
            there = ties.join(state, "host").select("host", "domain", "n", *passed)
            sums = there.groupBy("domain").agg(*(F.sum(c).alias(f"{c}_sum") for c in SCORES))
            got.append(join_spread(there, sums, "domain", hot=hot_domains).select("host", *(((F.col(f"{c}_sum") - F.col(c)) / (F.col("n") - 1)).alias(c) for c in SCORES)))
        received = (got[0] if len(got) == 1 else got[0].unionByName(got[1])).groupBy("host").agg(*(F.sum(c).alias(f"{c}_in") for c in SCORES))
        after = start.join(received, "host", "left").select("host", *(((1 - damping) * F.col(c) + damping * F.coalesce(f"{c}_in", F.lit(0.0))).alias(c) for c in SCORES))
        new = written(after, "host-scores")
        if state is not start:
            remove(state)
        state = new
    out = written(own.join(state, "host"), "host-scored")
    for table in {id(t): t for t in (links, own, start, kin, total, both, ties, state)}.values():
        remove(table)
    return out


def badness(held: str = "") -> Column:
    """Distrust less trust, each in relation to what reached the host; between -1 and 1."""
    part = lambda a, b: F.coalesce(F.col(a + held) / F.nullif(F.col(b + held), F.lit(0.0)), F.lit(0.0))
    return part("distrust", "back") - part("trust", "reach")


def levels() -> list[float]:
    """Levels of the grid, at odd multiples, so that equal shares lie on none."""
    return [(2 * k + 1 - LEVELS) / LEVELS for k in range(LEVELS)]


def found_again(scores: DataFrame) -> list[tuple[float, int, int, int, int]]:
    """(level, bad hosts found, bad hosts, good hosts falsely found, good hosts) of the hidden seeds, for each level."""
    seen = scores.filter(hidden(F.col("host")) & (F.col("trusted") != F.col("blocked"))).select((F.col("blocked") > F.col("trusted")).alias("bad"), badness("_held").alias("b"))
    bad = F.col("bad")
    counts = seen.agg(F.count_if(bad), F.count_if(~bad), *(F.count_if((bad if k == 0 else ~bad) & (F.col("b") > level)) for level in levels() for k in (0, 1))).first()
    return [(level, counts[2 + 2 * k], counts[0], counts[3 + 2 * k], counts[1]) for k, level in enumerate(levels())]


def cut_of(found: list[tuple[float, int, int, int, int]]) -> float:
    """The middle of the levels at which recall less the share of falsely blocked hosts is highest; CUT if one kind is missing."""
    gain = [tp * good - fp * bad for _, tp, bad, fp, good in found]
    if not found or not found[0][2] or not found[0][4]:
        return CUT
    best = [f[0] for f, g in zip(found, gain, strict=True) if g == max(gain)]
    return best[(len(best) - 1) // 2]


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, cut: float | None = None, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict of each page; the cut comes from hidden seeds unless it is given."""
    judged = written(ruled(pages, rules), "pages-ruled")
    scores = propagate(link_edges(judged), seeds_of(judged), damping, rounds)
    level = cut_of(found_again(scores)) if cut is None else cut
    blocked = written(scores.filter(badness() > level).select("host", F.lit("block").alias("spread")), "blocked-hosts")
    out = lookup(judged.select("page_id", "host", "path", "judged"), blocked, "host", "left")
    return out.select("page_id", "host", "path", F.col("judged.rule").alias("rule"), F.coalesce("judged.verdict", "spread", F.lit("allow")).alias("verdict"))


def oracle_sql(rules: Sequence[Rule] = RULES, damping: float = DAMPING, rounds: int = ROUNDS) -> str:
    """judge() in DuckDB SQL, with ties as explicit pairs and its rounds written one after the other."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    host = lambda u: f"translate(regexp_extract(substr({u}, instr({u}, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = [(f"(host = {quoted(r.host)} OR ends_with(host, {quoted('.' + r.host)})) AND starts_with(path, {quoted(r.path)})", r) for r in sorted(rules, key=lambda r: -len(r.text))]
    case = lambda value: "CASE " + " ".join(f"WHEN {c} THEN {quoted(value(r))}" for c, r in fits) + " END"
    second = ", ".join(map(quoted, SECOND_LEVEL))
    link = r"""href\s*=\s*["'']?(https?://[^"''\s>]+)"""
    table = ", ".join(f"c{k + 1} AS (SELECT list_transform(x, lambda v: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS x FROM c{k})" for k in range(8))
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * octet_length(encode(host)), 2), lambda k: ('0x' || substr(hex(encode(host)), k, 2))::BIGINT)), lambda a, d: xor(a >> 8, x[(xor(a & 255, d) + 1)::INT])), 4294967295)"
    any_, held = f"greatest(trusted + blocked, {NEUTRAL})", f"greatest((trusted + blocked) * o, {NEUTRAL})"
    seeds = {"trust": "trusted", "reach": any_, "trust_held": "trusted * o", "reach_held": held, "distrust": "blocked", "back": any_, "distrust_held": "blocked * o", "back_held": held}
    way = lambda c: "a" if c in ALONG else "b"
    steps = ", ".join(
        f"s{k + 1} AS MATERIALIZED (SELECT i.host, {', '.join(f'(1 - {damping}::DOUBLE) * any_value(i.{c}) + {damping}::DOUBLE * coalesce(sum(s.{c} * m.{way(c)}), 0) AS {c}' for c in SCORES)} FROM s0 i LEFT JOIN moves m ON m.dest = i.host LEFT JOIN s{k} s ON s.host = m.host GROUP BY i.host)"
        for k in range(rounds)
    )
    bad = lambda held: f"coalesce(distrust{held} / nullif(back{held}, 0), 0) - coalesce(trust{held} / nullif(reach{held}, 0), 0)"
    return f"""
WITH c0 AS (SELECT range(256) AS x), {table},
u AS (SELECT page_id, html, coalesce(url, '') AS url FROM pages),
h AS (SELECT *, CASE WHEN instr(url, '://') > 0 THEN {host("url")} ELSE '' END AS host,
  CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
j AS MATERIALIZED (SELECT page_id, html, host, path, {case(lambda r: r.text)} AS rule, {case(lambda r: r.verdict)} AS said FROM h),
l AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1, 'i'), lambda x: {host("x")}))) AS dst FROM j WHERE host <> ''),
e AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS w FROM l WHERE src <> dst AND dst <> '' GROUP BY ALL),
seed AS (SELECT host, avg(CASE WHEN said = 'allow' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS trusted, avg(CASE WHEN said = 'block' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS blocked FROM j WHERE host <> '' GROUP BY host),
own AS MATERIALIZED (SELECT host, coalesce(trusted, 0) AS trusted, coalesce(blocked, 0) AS blocked, {crc} % {HIDDEN} = 0 AS hid FROM (SELECT host FROM seed UNION SELECT src FROM e UNION SELECT dst FROM e) LEFT JOIN seed USING (host), c8),
nm AS (SELECT host, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS name FROM own),
lab AS (SELECT host, name, string_split(name, '.') AS p FROM nm),
dom AS (SELECT host, CASE WHEN regexp_matches(name, '^[0-9.]+$|^[[]|^$') THEN [name] ELSE
  list_transform(range(1, greatest(1, len(p) - CASE WHEN len(p) > 2 AND length(p[-1]) = 2 AND p[-2] IN ({second}) THEN 2 ELSE 1 END)::BIGINT + 1), lambda k: array_to_string(p[k:], '.')) END AS ds FROM lab),
kin AS MATERIALIZED (SELECT host, unnest(ds) AS domain FROM dom),
ties AS (SELECT a.host AS src, b.host AS dst, sum({FAMILY}::DOUBLE / (n - 1)) AS w FROM kin a JOIN kin b ON a.domain = b.domain AND a.host <> b.host JOIN (SELECT domain, count(*) AS n FROM kin GROUP BY domain) c ON c.domain = a.domain GROUP BY a.host, b.host),
every AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM e UNION ALL SELECT * FROM ties) GROUP BY ALL),
share AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS a, w / sum(w) OVER (PARTITION BY dst) AS b FROM every),
moves AS MATERIALIZED (SELECT host, dest, sum(a) AS a, sum(b) AS b FROM (SELECT src AS host, dst AS dest, a, 0.0::DOUBLE AS b FROM share UNION ALL SELECT dst, src, 0.0::DOUBLE, b FROM share) GROUP BY ALL),
s0 AS MATERIALIZED (SELECT host, {", ".join(f"{seeds[c]} AS {c}" for c in SCORES)} FROM (SELECT *, CASE WHEN hid THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS o FROM own)),
{steps},
seen AS (SELECT blocked > trusted AS bad, {bad("_held")} AS b FROM s{rounds} JOIN own USING (host) WHERE hid AND trusted <> blocked),
grid AS (SELECT level, (count(*) FILTER (bad AND b > level))::BIGINT * any_value(good_n) - (count(*) FILTER (NOT bad AND b > level))::BIGINT * any_value(bad_n) AS gain
  FROM (SELECT (2 * k + 1 - {LEVELS})::DOUBLE / {LEVELS} AS level FROM range({LEVELS}) g(k)), seen, (SELECT count(*) FILTER (bad) AS bad_n, count(*) FILTER (NOT bad) AS good_n FROM seen) WHERE bad_n > 0 AND good_n > 0 GROUP BY level),
best AS (SELECT list(level ORDER BY level) AS ls FROM grid WHERE gain = (SELECT max(gain) FROM grid)),
cut AS (SELECT coalesce((SELECT ls[(len(ls) + 1) // 2] FROM best), {CUT}) AS level),
b AS (SELECT host FROM s{rounds}, cut WHERE {bad("")} > level)
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN b.host IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM j LEFT JOIN b ON b.host = j.host
"""
