"""Host reputation for the media addresses of frames: beta-binomial shrinkage from suffix to registered domain to host."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, need, stage


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains under ``path``; the rule is written host and path, as in ``example.org/en/1``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end. Both are
    empty for null and for an address without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix): the last two labels and the last one, as of names below a one-label public suffix."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def _shrunk(counts: DataFrame, child: str, parent: DataFrame | None, up: str | None, prior: float) -> DataFrame:
    """(child, _mean, _weight): mean of bad outcomes of each child, shrunk towards its parent's by a strength from the spread of the children.

    A child's prior is its parent's posterior without the child's own outcomes. The strength is the beta-binomial moment estimate over all children of the level: much spread gives a weak prior, none beyond chance the strongest (1000).
    """
    if parent is None:
        base = counts.agg(((F.sum("_bad") + 0.5) / (F.sum("_all") + 1.0)).alias("_prior"))
        joined = counts.join(F.broadcast(base))  # one row
    else:
        given = parent.select(F.col(parent.columns[0]).alias(up), (F.col("_mean") * F.col("_weight")).alias("_a"), F.col("_weight").alias("_n"))
        # a child's own outcomes are no evidence for its prior
        joined = counts.join(given, up).withColumn("_prior", (F.col("_a") - F.col("_bad")) / (F.col("_n") - F.col("_all")))
    share = F.col("_bad") / F.col("_all")
    expected = F.col("_prior") * (1 - F.col("_prior"))
    # E[(share - prior)^2] = p(1-p) (1/n + (1 - 1/n) rho) and strength = 1/rho - 1
    rho = F.sum(F.col("_all") * ((share - F.col("_prior")) ** 2 / expected) - 1.0) / F.sum(F.col("_all") - 1.0)
    r = F.col("_rho")
    held = F.when(r <= 0.001, 1000.0).when(r > 0.001, F.greatest(1.0 / r - 1.0, F.lit(1.0))).otherwise(prior)  # null: nothing to estimate it from
    strength = joined.where("_all > 1").agg(rho.alias("_rho")).select(held.alias("_strength"))
    a = F.col("_bad") + F.col("_prior") * F.col("_strength")
    n = F.col("_all") + F.col("_strength")
    return joined.join(F.broadcast(strength)).select(child, (a / n).alias("_mean"), n.alias("_weight"), "_bad", "_all", "_strength")


def host_reputation(outcomes: DataFrame, host: str = "host", bad: str = "bad", prior: float = 10.0) -> DataFrame:
    """Per host with outcomes: ``host``, ``n_outcomes``, ``n_bad``, ``bad_mean`` and ``bad_sd`` of its posterior share of bad outcomes.

    Counts are beta-binomial at every level: a host's prior is its registered domain's posterior mean, a domain's its suffix's, a suffix's the
    overall share. ``prior`` is the strength where there is nothing to estimate it from. ``bad`` is boolean; nulls are left out.
    """
    domain, suffix = levels(F.col("_host"))
    seen = outcomes.select(F.col(f"`{host}`").alias("_host"), F.col(f"`{bad}`").alias("_is")).where("_host is not null and _is is not null")
    hosts = seen.groupBy("_host").agg(F.sum(F.col("_is").cast("long")).alias("_bad"), F.count(F.lit(1)).alias("_all")).withColumn("_domain", domain).withColumn("_suffix", suffix)
    # one row per host: written once, so that no level reads the outcomes again
    hosts = stage(hosts, "hosts")
    domains = hosts.groupBy("_domain", "_suffix").agg(F.sum("_bad").alias("_bad"), F.sum("_all").alias("_all"))
    suffixes = domains.groupBy("_suffix").agg(F.sum("_bad").alias("_bad"), F.sum("_all").alias("_all"))
    of_suffix = stage(_shrunk(suffixes, "_suffix", None, None, prior), "suffixes")
    of_domain = stage(_shrunk(domains, "_domain", of_suffix, "_suffix", prior), "domains")
    of_host = _shrunk(hosts, "_host", of_domain, "_domain", prior)
    sd = F.sqrt(F.col("_mean") * (1 - F.col("_mean")) / (F.col("_weight") + 1))
    return of_host.select(F.col("_host").alias("host"), F.col("_all").alias("n_outcomes"), F.col("_bad").alias("n_bad"), F.col("_mean").alias("bad_mean"), sd.alias("bad_sd"))


def screen_media_addresses(
    frames: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), frame: str = "frame_id", address: str = "image_path", bad: str = "bad", limit: float = 0.5, bound: float = 1.64,
) -> DataFrame:
    """Which frames to take by the address of their image: a rule's verdict, else the reputation of the host.

    ``outcomes`` are (``frame``, ``bad``): frames whose check ended well (false) or not (true); a frame may have several. Returns per row of ``frames``: ``frame``,
    ``host``, ``path``, ``rule`` (text of the longest that fits, else null), ``verdict`` (allow or block), ``bad_mean`` and ``bad_low`` (posterior mean of the host's
    share of bad outcomes and its lower bound, ``bound`` standard deviations below; null for a host without outcomes).

    A host is blocked if even the lower bound is above ``limit``: little evidence does not block, and hosts without outcomes are allowed. Column functions and joins
    only. Outcomes are counted per frame, then per host before the shuffle, so a host of a third of all frames costs one row per task.

    Null addresses and those without ``://`` have empty host and path and are judged as the host "". Null frames and repeated rows are kept, each with its verdict; a
    null ``bad`` does not count; empty tables give no rows or no reputation; further columns are ignored.
    """
    free(frame, "host", "path", "rule", "verdict", "bad_mean", "bad_low")
    host, path = host_and_path(F.col(f"`{address}`"))
    rows = need(frames, frame, address).select(F.col(f"`{frame}`").alias("_frame"), host.alias("host"), path.alias("path"))
    results = need(outcomes, frame, bad).select(F.col(f"`{frame}`").alias("_of"), F.col(f"`{bad}`").alias("_bad"))
    known = host_reputation(rows.join(results, F.col("_frame") == F.col("_of")).select("host", "_bad"), "host", "_bad")
    text, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    low = F.col("bad_mean") - bound * F.col("bad_sd")
    judged = rows.join(known.select("host", "bad_mean", low.alias("bad_low")), "host", "left")
    by_host = F.when(F.col("bad_low") > limit, "block").otherwise("allow")
    return judged.select(F.col("_frame").alias(frame), "host", "path", text.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "bad_mean", "bad_low")
