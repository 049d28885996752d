"""Quality rules of single documents, and verdicts on hosts drawn from them, in DataFrame functions alone.

Each text gets counts of words, symbols, repeated lines and repeated three-word windows. A host is a value of
`source` (documents carry no address). Per host and rule the failures are summed; an empirical beta prior,
fitted by the moments of the hosts' own rates, shrinks them, so that a host with few documents keeps near the
corpus. A host is bad in a rule where, by its posterior, its rate is likely above that of the corpus: SURE standard
deviations, which is odds of three to one. The verdict goes back to the documents: on a bad host documents that fail this
rule's lower bound go too; what fails a rule outright goes everywhere. Documents that fail nothing are kept, also on bad hosts.

Nulls: a null text has no words and fails; a null source is a host like others. Empty tables give empty
results. Repeated rows are judged alike and each counts. Very long texts are judged whole. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import columns_of, place_of, written

MIN_WORDS = 50
#: Standard deviations of a host's posterior by which its mean lies above the corpus rate: odds of three to one.
SURE = 0.6745
#: The prior weighs as that many documents at most, and as two at least.
PRIOR = 200.0
#: Hosts whose verdicts may be broadcast; beyond, the join is a shuffle with hot hosts dealt over SALT keys.
BROADCAST_HOSTS = 100_000
SALT = 64
#: rule: (fails outright, fails on a host where this rule often fails)
RULES = ("symbols", "dup_lines", "repeats", "long_words")

_BLANK = r"[\x20\x09-\x0D]+"


def _bind(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _BLANK), "")


def repeated_words(ws: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text; ws must be a bound variable.

    The windows' hashes (64 bits) are sorted; where no neighbours are equal, as in most texts, that is all. A few
    repeated hashes are looked up in place; many are found by sorting the hashes with their places. The places,
    in order, then cover three words each, less what the next one covers: n log n in the text's length.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(F.size(ws) < 4, F.lit(0).cast("bigint")).otherwise(_bind(hashes, lambda h: _bind(F.sort_array(h), lambda s: _bind(_repeats(s), lambda twice: F.when(F.size(twice) == 0, F.lit(0).cast("bigint")).otherwise(_covered(F.when(F.size(twice) <= 16, _few(h, twice)).otherwise(_many(h))))))))


def _repeats(s: Column) -> Column:
    return F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1) == x, F.lit(False)))


def _few(h: Column, twice: Column) -> Column:
    return F.array_compact(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)))


def _many(h: Column) -> Column:
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
    return _bind(placed, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))


def _covered(places: Column) -> Column:
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bound = _bind(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    lines = _bind(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("bigint")
    one = docs.select(*keep, F.struct(bound.alias("w"), lines.alias("l"), symbols.alias("s")).alias("_f"))
    n, repeat = F.col("_f.w.n_words"), F.col("_f.w.n_repeat_words")
    return one.select(*keep, n.alias("n_words"), F.col("_f.w.word_chars").alias("word_chars"), F.col("_f.s").alias("n_symbols"), F.col("_f.l.n_dup_lines").alias("n_dup_lines"), repeat.alias("n_repeat_words"), F.col("_f.l.n_lines").alias("n_lines"), ((n < MIN_WORDS) | (100 * repeat > 50 * n)).alias("base_failed"))


def _fails() -> dict[str, tuple[Column, Column]]:
    n, c = F.col("n_words"), F.col("word_chars")
    return {
        "symbols": (F.col("n_symbols") > n, 4 * F.col("n_symbols") > n),
        "dup_lines": ((F.col("n_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines")), (F.col("n_lines") >= 4) & (4 * F.col("n_dup_lines") > F.col("n_lines"))),
        "repeats": (100 * F.col("n_repeat_words") > 50 * n, 100 * F.col("n_repeat_words") > 35 * n),
        "long_words": (c > 30 * n, c > 20 * n),
    }


def host_rates(feats: DataFrame, host: str = "source") -> DataFrame:
    """A row for each host: its documents, and for each rule its shrunken rate (p_) and by how many standard deviations of its
    posterior this lies above the corpus rate (z_).

    The prior of a rule is beta(m k, (1 - m) k): m is the corpus rate, k = m (1 - m) / v - 1 with v the hosts'
    variance about m beyond that of chance (hosts weigh by their documents), so hosts that differ little are drawn
    strongly together.
    """
    fails = _fails()
    sums = written(feats.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *[F.count_if(fails[r][0]).alias(f"f_{r}") for r in RULES]), "hosts")
    total = sums.agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), *[F.sum(f"f_{r}").alias(r) for r in RULES]).first()
    if not total["hosts"]:
        return sums.select("host", "n", *[F.lit(0.0).alias(f"{x}_{r}") for r in RULES for x in "pz"])
    mean = {r: total[r] / total["n"] for r in RULES}
    spread = sums.agg(*[(F.sum(F.col("n") * F.pow(F.col(f"f_{r}") / F.col("n") - mean[r], 2) - mean[r] * (1 - mean[r])) / F.greatest(F.lit(1), F.sum(F.col("n") - 1))).alias(r) for r in RULES]).first()
    out = []
    for r in RULES:
        m, v = mean[r], spread[r]
        k = min(PRIOR, max(2.0, m * (1 - m) / v - 1)) if v > 0 else PRIOR
        p = (F.col(f"f_{r}") + m * k) / (F.col("n") + k)
        deviation = F.sqrt(p * (1 - p) / (F.col("n") + k + 1))
        out += [p.alias(f"p_{r}"), F.when(deviation > 0, (p - m) / deviation).otherwise(0.0).alias(f"z_{r}")]
    return sums.select("host", "n", *out)


def with_verdict(feats: DataFrame, hosts: DataFrame, host: str = "source", sure: float = SURE) -> DataFrame:
    """feats with kept and the rules that failed. Only hosts that are bad in some rule take part in the join."""
    bad = hosts.select("host", *[(F.col(f"z_{r}") > sure).alias(f"_b_{r}") for r in RULES])
    bad = written(bad.where(" or ".join(f"_b_{r}" for r in RULES)), "bad-hosts")
    if bad.count() <= BROADCAST_HOSTS:
        joined = feats.join(F.broadcast(bad), F.col(host).eqNullSafe(F.col("host")), "left")
    else:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in ("doc_id", "n_words", "word_chars")]), F.lit(SALT))
        many = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
        joined = feats.withColumn("_s", salt).join(many, (F.col(host).eqNullSafe(F.col("host"))) & (F.col("_s") == F.col("_salt")), "left").drop("_s", "_salt")
    failed = F.array_compact(F.array(*[F.when(out | (F.coalesce(F.col(f"_b_{r}"), F.lit(False)) & low), F.lit(r)) for r, (out, low) in _fails().items()]))
    return joined.withColumn("failed_rules", failed).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.size("failed_rules") == 0)).drop("host", *[f"_b_{r}" for r in RULES])


def judge(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """doc_id, the counts, base_failed, kept and failed_rules of each document.

    The counts are written once, without the texts; hosts are summed from them and joined back to them.
    """
    feats = written(features(columns_of(docs, "doc_id", "text", "source"), ["doc_id", "source"]), "rule-counts")
    return with_verdict(feats, host_rates(feats), sure=sure).drop("source", "n_lines")


def filtered(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """The documents that are kept, with their columns.

    The counts are worked out once: the rows are written with them, hosts are summed from there, and the rows that pass are
    read back.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: F.col(f"c{place_of(docs, n)}").alias(f"_{n}") for n in ("doc_id", "text", "source")}
    rows = features(plain.select("*", at["doc_id"].alias("doc_id"), at["text"].alias("text"), at["source"]), [*plain.columns, "doc_id", "_source"])
    counted = written(rows, "counted")
    hosts = host_rates(counted, "_source")
    return with_verdict(counted, hosts, "_source", sure).where("kept").select(*[F.col(c).alias(n) for c, n in zip(plain.columns, names, strict=True)])


_SOFT = {"symbols": ("n_symbols > n_words", "4 * n_symbols > n_words"), "dup_lines": ("n_lines >= 4 and 2 * n_dup_lines > n_lines", "n_lines >= 4 and 4 * n_dup_lines > n_lines"), "repeats": ("100 * n_repeat_words > 50 * n_words", "100 * n_repeat_words > 35 * n_words"), "long_words": ("word_chars > 30 * n_words", "word_chars > 20 * n_words")}


def _sql() -> str:
    """The whole judgement in DuckDB SQL."""
    fails = ", ".join(f"({out}) as o_{r}, ({low}) as l_{r}" for r, (out, low) in _SOFT.items())
    sums = ", ".join(f"count_if(o_{r}) as f_{r}" for r in RULES)
    mean = ", ".join(f"sum(f_{r}) / sum(n) as m_{r}" for r in RULES)
    spread = ", ".join(f"sum(n * (f_{r} / n - m_{r}) ** 2 - m_{r} * (1 - m_{r})) / greatest(1, sum(n - 1)) as v_{r}, any_value(m_{r}) as m_{r}" for r in RULES)
    prior = ", ".join(f"case when v_{r} > 0 then least({PRIOR}, greatest(2.0, m_{r} * (1 - m_{r}) / v_{r} - 1)) else {PRIOR} end as k_{r}, m_{r}" for r in RULES)
    shrunk = ", ".join(f"(f_{r} + m_{r} * k_{r}) / (n + k_{r}) as p_{r}, m_{r}, n + k_{r} + 1 as d_{r}" for r in RULES)
    bad = ", ".join(f"(p_{r} * (1 - p_{r}) > 0 and (p_{r} - m_{r}) / sqrt(p_{r} * (1 - p_{r}) / d_{r}) > {SURE}) as b_{r}" for r in RULES)
    failed = ", ".join(f"case when o_{r} or (b_{r} and l_{r}) then '{r}' end" for r in RULES)
    return rf"""
with texts as (select row_number() over () as row, doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select row, i, count(*) over (partition by row, a, b, c) as n from (select row, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select row, w, unnest(range(1, len(w) - 1)) as i from texts))),
covered as (select row, count(distinct i + j) as n from windows, (select unnest([0, 1, 2]) as j) where n > 1 group by row),
lined as (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from texts),
counts as (select doc_id, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, len(lines) as n_lines from lined l left join covered c on c.row = l.row),
failing as (select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) as base_failed, {fails} from counts),
hosts as (select source, count(*) as n, {sums} from failing group by source), means as (select {mean} from hosts), spreads as (select {spread} from hosts, means), priors as (select {prior} from spreads),
shrunk as (select source, {shrunk} from hosts, priors), verdicts as (select source, {bad} from shrunk),
judged as (select f.*, list_filter([{failed}], lambda x: x is not null) as failed from failing f join verdicts v on f.source is not distinct from v.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and len(failed) = 0) as kept, array_to_string(failed, ',') as failed_rules from judged
"""


SQL = _sql()
