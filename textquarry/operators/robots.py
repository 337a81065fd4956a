"""Robots gate: which addresses the landed robots files let an agent read.

Of a file the groups of the agent count, or those of ``*`` if it has none of
its own.  Among the rules that match an address's path the longest decides, and
``Allow`` among equally long ones; without a rule, or without a file, the
address is allowed.  ``*`` stands for any characters, a ``$`` at the end for the
end of the path.  Files are one row per host, so the join is by host; a host
with very many addresses is split by the skew join.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a file that are read, as the standard for robots files has it (500 KiB at least).
MOST = 512_000
RULES = "array<struct<allow:boolean,pattern:string,regex:string>>"


def as_regex(pattern: str) -> str | None:
    """A pattern with ``*`` or ``$`` as a regular expression that never goes back; null for a plain prefix."""
    ends = pattern.endswith("$")
    first, *parts = pattern.removesuffix("$").split("*")
    if not parts and not ends:
        return None
    quote = lambda s: "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in s)
    middle = "".join(f"(?>.*?{quote(p)})" for p in (parts[:-1] if ends and parts else parts))
    last = (f".*{quote(parts[-1])}" if parts else "") + "$" if ends else ""
    return f"(?s)^{quote(first)}{middle}{last}"


def rules_of(body: str | None, agent: str) -> list[tuple[bool, str, str | None]]:
    """The rules of a robots file for an agent, each once."""
    groups: dict[str, dict[tuple[bool, str], None]] = {}
    names: list[str] = []
    open_ = False
    for line in (body or "")[:MOST].splitlines():
        field, _, value = line.partition("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            names = [*(names if open_ else []), value.lower()]
            open_ = True
            groups.setdefault(names[-1], {})
        elif field in ("allow", "disallow"):
            open_ = False
            if value.startswith(("/", "*")):
                for name in names:
                    groups[name][field == "allow", value] = None
    own = [g for name, g in groups.items() if name != "*" and re.match(re.escape(name) + r"(?![a-z_-])", agent.lower())] if agent else []
    chosen = own or [groups.get("*", {})]
    return [(allow, p, as_regex(p)) for allow, p in dict.fromkeys(rule for g in chosen for rule in g)]


def parsed(body: Column, agent: str) -> Column:
    @F.pandas_udf(RULES)
    def parse(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [{"allow": a, "pattern": p, "regex": r} for a, p, r in rules_of(b if isinstance(b, str) else None, agent)])

    return parse(body)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Path and query of an address, ``/`` for none."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))


def gate(urls: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """``urls`` with allowed and rule (the pattern that decided, null for none).

    ``robots`` has host and body; of several bodies of a host all rules count.
    """
    files = robots.select(F.lower("host").alias("__host"), parsed(F.col("body"), agent).alias("r"))
    rules = files.groupBy("__host").agg(F.array_distinct(F.flatten(F.collect_list("r"))).alias("__rules"))
    placed = urls.withColumns({"__host": host_of(F.col(url)), "__path": path_of(F.col(url))}).join(rules, "__host", "left")
    matching = F.filter("__rules", lambda r: F.when(r["regex"].isNull(), F.startswith(F.col("__path"), r["pattern"])).otherwise(F.regexp_like(F.col("__path"), r["regex"])))
    best = F.array_max(F.transform(matching, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"), r["pattern"].alias("pattern"))))
    found = placed.withColumn("__best", best)
    return found.select(*urls.columns, F.coalesce("__best.allow", F.lit(True)).alias("allowed"), F.col("__best.pattern").alias("rule"))
