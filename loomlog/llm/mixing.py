"""Mix documents to target domain weights through soft memberships.

1. A classifier learned from a table of labelled documents gives each document a posterior over the
   domains: multinomial naive Bayes over hashed words, as one lookup table of log-likelihoods a domain.
2. Projected-gradient least squares finds a rate r >= `lowest` for every document, such that the
   expected tokens of each domain, sum(r * tokens * posterior), match the targets. A rate depends on a document's
   posterior and not on its length. Rates stay a column: each pass over the documents returns one number a domain to the driver.
   Targets that no rates meet are warned of, with the gap of each domain.
3. A rate is turned into whole copies by a hash of the id and the text, whose expectation is the rate.

Built-in functions only; tokens are words between white space, as no encoder is built in. The classifier is fitted on at most `max_labelled` labelled documents, those
with the smallest id hash; everything else covers all rows.

Defined cases: a null text counts as empty and has no tokens, the prior as posterior and its rate like
any other; labels of a null domain are left out (documents are
still scored); of posteriors that tie the first domain in order is `domain`; targets for unknown domains are refused; repeated rows are equal documents; an empty
table gives an empty result; columns of the documents that are named like the new ones give way to them.
"""

import math
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.common import stage

BUCKETS, MAX_LABELLED = 8192, 20_000
WHITE = r"[\x20\x09-\x0D]+"
NEW = ("n_tokens", "posterior", "domain", "rate", "copies")


def _words(column: str):
    return F.filter(F.split(F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))), WHITE), lambda w: w != "")


def _bucket(word):
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def learn_tables(docs: DataFrame, labels: DataFrame, domain_col: str, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> dict[str, tuple[float, list[float]]]:
    """{domain: (log prior, log-likelihood of each word bucket)} from the labelled documents.

    labels has the id and the domain. At most BUCKETS counts a domain reach the driver; a domain has at least one of the `max_labelled` rows.
    """
    named = labels.select(F.col(id_col).alias("i"), F.col(domain_col).cast("string").alias("d")).where("i is not null and d is not null")
    chosen = named.orderBy(F.xxhash64("i"), "i", "d").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i")  # at most max_labelled narrow rows
    sizes = {r.d: r.n for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = rows.where(F.col("d").isin(list(sizes))).select("d", F.explode(_words("t")).alias("w")).groupBy("d", _bucket(F.col("w")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    table = {d: [0.5] * BUCKETS for d in sizes}
    for r in counts.collect():
        table[r.d][r.b] += r.n
    every = sum(sizes.values())
    return {d: (math.log(sizes[d] / every), [math.log(x / total) for x in table[d]]) for d in sorted(sizes) for total in [sum(table[d])]}


def _own(docs: DataFrame) -> str:
    """A prefix that no column of docs has."""
    prefix = "__mix"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return prefix


def _adding(lookup):
    return lambda acc, b: acc + F.get(lookup, b)


def with_posteriors(docs: DataFrame, tables: dict[str, tuple[float, list[float]]], text_col: str = "text", evidence: float | None = None) -> DataFrame:
    """docs with n_tokens and posterior (an array in the order of `tables`).

    With `evidence`, a text's mean log-likelihood counts as so many words at most, which softens the memberships of long texts.
    """
    own = _own(docs)
    buckets, top, every = f"{own}_buckets", f"{own}_top", f"{own}_all"
    made = docs.withColumn(buckets, F.transform(_words(text_col), _bucket)).withColumn("n_tokens", F.size(buckets).cast("long"))
    each = [f"{own}_score_{k}" for k in range(len(tables))]
    scores = {}
    for name, (prior, table) in zip(each, tables.values()):
        # one literal array, folded at planning: a lookup by place
        lookup = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
        total = F.aggregate(buckets, F.lit(0.0), _adding(lookup))
        scores[name] = F.lit(prior) + (total if evidence is None else total * F.least(F.lit(1.0), F.lit(evidence) / F.greatest(F.col("n_tokens"), F.lit(1))))
    made = made.withColumns(scores).drop(buckets)
    made = made.withColumn(top, F.greatest(*each) if len(each) > 1 else F.col(each[0]))
    made = made.withColumns({name: F.exp(F.col(name) - F.col(top)) for name in each})
    made = made.withColumn(every, sum((F.col(name) for name in each), F.lit(0.0)))
    return made.withColumn("posterior", F.array(*[F.col(name) / F.col(every) for name in each])).drop(top, every, *each)


def _mass(members: DataFrame, size: int) -> list[float]:
    """sum(rate * n_tokens * posterior) of each domain."""
    got = members.agg(*[F.coalesce(F.sum(F.col("rate") * F.col("n_tokens") * F.get("posterior", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in range(size)]).first()
    return [float(x) for x in got]


def _scale(mass: list[float]):
    """One over the tokens of the domains that a document belongs to: how far its rate moves for a gap of one token."""
    held = sum((F.get("posterior", F.lit(i)) * float(m) for i, m in enumerate(mass)), F.lit(0.0))
    return F.when(held > 0, 1.0 / held).otherwise(0.0)


def _rate(steps: list[list[float]], mass: list[float], lowest: float, start=None):
    """The rate after the given gradient steps from `start`, as one fold over them for each document's `posterior`."""
    begin = F.lit(float(max(1.0, lowest))) if start is None else start
    if not steps:
        return begin
    k = len(mass)
    scale = _scale(mass)
    flat = F.split(F.lit(",".join(repr(float(x)) for step in steps for x in step)), ",").cast("array<double>")

    def after(rate, step):
        return F.greatest(F.lit(float(lowest)), rate + scale * sum((F.get("posterior", F.lit(i)) * F.get(flat, step * k + i) for i in range(k)), F.lit(0.0)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), begin, after)


def fit_rates(members: DataFrame, targets: list[float], lowest: float = 0.0, passes: int = 60, tolerance: float = 1e-6, raising: bool = False, most: float = 64.0, fold: int = 8) -> tuple[list[list[float]], list[float], list[float]]:
    """(steps, tokens of each domain, gaps left): steps that bring sum(rate * n_tokens * posterior) to the targets, see `_rate`.

    members has n_tokens and posterior. Projected gradient on the sum of the squared gaps, for rates of `lowest` and more. A document's
    step is scaled by the tokens of its domains (a diagonal metric, in which a rare domain moves as fast as a common
    one) and by a bound of the curvature in that metric. With `raising`, for rates that may only grow, the total of the targets is raised
    to what the fullest domain holds after each step, as what is added to a domain adds to others too, up to `most` times.

    Stops when no gap exceeds `tolerance` of all target tokens, or when `passes` are done or ten of them gain less than
    one part in a hundred: targets out of reach are warned of, with the gap of each domain. Rates so far are written every `fold` steps,
    so that no pass repeats more than those.
    """
    size = len(targets)
    mass = _mass(members.withColumn("rate", F.lit(1.0)), size)
    # rows of the curvature's matrix sum to these, and it has no negative entries
    curvature = max(_mass(members.withColumn("rate", _scale(mass)), size), default=0.0) or 1.0
    now, steps, folded, trail = members.withColumn("rate", _rate([], mass, lowest)), [], 0, []
    ceiling = most * max(sum(targets), 1.0)
    while True:
        got = _mass(now.withColumn("rate", _rate(steps[folded:], mass, lowest, F.col("rate"))), size)
        if raising:
            up = max((g / t for g, t in zip(got, targets) if t > 0), default=1.0)
            targets = [t * max(up, 1.0) for t in targets]
        gaps = [t - g for t, g in zip(targets, got)]
        trail.append(max(map(abs, gaps), default=0.0) / max(sum(targets), 1.0))
        if trail[-1] <= tolerance or len(trail) > passes or len(trail) > 20 and trail[-1] > 0.99 * trail[-11] or sum(targets) > ceiling:
            break
        steps.append([(max(g, 0.0) if raising else g) / curvature for g in gaps])
        if len(steps) - folded == fold:
            now, folded = stage(now.withColumn("rate", _rate(steps[folded:], mass, lowest, F.col("rate"))), "rates"), len(steps)
    if trail[-1] > tolerance:
        warnings.warn(f"rates miss the targets by up to {trail[-1]:.2e} of all target tokens after {len(steps)} passes; gaps in tokens: {[round(g, 1) for g in gaps]}", stacklevel=2)
    return steps, mass, gaps


def domain_targets(members: DataFrame, weights: list[float], budget: float | None, never_below: bool) -> list[float]:
    """Target tokens of each domain: shares of `budget`, of the tokens there are, or, with
    `never_below`, of the smallest total at which no domain starts with more than its share."""
    mass = _mass(members.withColumn("rate", F.lit(1.0)), len(weights))
    total = sum(weights)
    shares = [w / total for w in weights]
    if never_below:
        budget = max((m / s for m, s in zip(mass, shares) if s > 0), default=0.0)
    elif budget is None:
        budget = sum(mass)
    return [budget * s for s in shares]


def expected_shares(mixed: DataFrame, domains: list[str]) -> DataFrame:
    """(domain, tokens, share): what the rates of a mix are expected to show of each domain; domains in the order of the posteriors."""
    each = mixed.select(F.posexplode("posterior").alias("k", "p"), (F.col("rate") * F.col("n_tokens")).alias("t")).groupBy("k").agg(F.sum(F.col("p") * F.col("t")).alias("tokens"))
    every = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row a domain
    return each.select(F.get(F.array(*map(F.lit, domains)), F.col("k")).alias("domain"), "tokens", (F.col("tokens") / every).alias("share"))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], domain_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", budget: float | None = None, never_below: bool = False, lowest: float = 0.0, passes: int = 60, max_labelled: int = MAX_LABELLED, carry: bool = True) -> DataFrame:
    """docs (or, with carry=False, their ids only) with n_tokens, posterior, domain (the likeliest), rate and copies.

    `weights` names the share of tokens of each domain; labels has the id and `domain_col`.
    """
    if clash := set(NEW) & {id_col.lower(), text_col.lower()}:
        raise ValueError(f"the new columns {sorted(clash)} cannot take the place of the id or the text")
    tables = learn_tables(docs, labels, domain_col, id_col, text_col, max_labelled)
    if not tables:
        tables = {d: (math.log(1 / len(weights)), [math.log(1 / BUCKETS)] * BUCKETS) for d in sorted(weights)}
    elif unknown := set(weights) - set(tables):
        raise ValueError(f"no labelled documents of {sorted(unknown)}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs if carry else docs.select(id_col, text_col)
    chance = f"{_own(docs)}_chance"
    scored = with_posteriors(docs, tables, text_col).withColumn(chance, F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    # what the fit reads many times is written once; texts are not written again but scored a second time for the result
    if carry:
        members = stage(scored.select("n_tokens", "posterior"), "memberships")
        # always true, but not foldable: keeps the optimizer from writing the scores out again wherever the posterior is read
        scored = scored.withColumn("posterior", F.when(F.monotonically_increasing_id() >= 0, F.col("posterior")))
    else:
        scored = stage(scored.drop(text_col), "memberships")
        members = scored.select("n_tokens", "posterior")
    targets = domain_targets(members, [weights.get(d, 0.0) for d in tables], budget, never_below)
    steps, mass, _ = fit_rates(members, targets, lowest, passes, raising=never_below and lowest >= 1)
    names = F.array(*[F.lit(d) for d in tables])
    out = scored.withColumn("rate", _rate(steps, mass, lowest)).withColumn("domain", F.get(names, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1))
    return out.withColumn("copies", F.floor(F.col("rate") + F.col(chance)).cast("long")).drop(chance)
