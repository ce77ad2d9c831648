"""Rules over nodes as data: selectors, rules by tag, role, class and id, and the rules of single sites.

Each rule becomes one column expression over a node's tag and attributes, so any number of them is one projection. The
lists are configuration of the driver, as long as a person writes them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookloom.functions.text import url_host

_TAG = re.compile(r"[a-zA-Z][\w-]*|\*")
_TEST = re.compile(r"""([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$]?=)\s*["']?([^"'\]]*)["']?)?\s*\]""")


def attr(name: str) -> Column:
    """An attribute's value, empty where the node has none."""
    return F.expr(f"coalesce(attrs['{name}'], '')")


def either(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _compound(css: str) -> Column:
    at, conditions = 0, []
    if m := _TAG.match(css):
        at = m.end()
        if m.group() != "*":
            conditions.append(F.col("tag") == m.group().lower())
    while at < len(css):
        m = _TEST.match(css, at)
        if not m:
            raise ValueError(f"a selector takes tags, classes, ids and attributes only, not {css!r}")
        at = m.end()
        kind, name, key, how, value = m.groups()
        if kind == ".":
            conditions.append(F.array_contains(F.split(attr("class"), r"\s+"), name))
        elif kind == "#":
            conditions.append(attr("id") == name)
        elif how is None:
            conditions.append(F.map_contains_key("attrs", F.lit(key)))
        else:
            conditions.append({"=": attr(key) == value, "*=": attr(key).contains(value), "^=": attr(key).startswith(value), "$=": attr(key).endswith(value)}[how])
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


_COMBINED = re.compile(r"""((?:\[[^\]]*\]|[^\s>+~\[])+)(\s*[>+~]\s*|\s+|$)""")


def _steps(css: str) -> list[tuple[str, str]]:
    """The compounds of one selector, each with the combinator that stands before it."""
    out, at, before = [], 0, ""
    while at < len(css):
        m = _COMBINED.match(css, at)
        if not m:
            raise ValueError(f"a selector is compounds with blanks, >, + or ~ between, not {css!r}")
        out.append((before, m.group(1)))
        before, at = m.group(2).strip() or " ", m.end()
    if not out or before != " ":
        raise ValueError(f"a selector ends with a compound, not {css!r}")
    return out


def _alternatives(css: str) -> list[str]:
    """The selectors between commas that stand outside of brackets."""
    return [x.strip() for x in re.findall(r"(?:\[[^\]]*\]|[^,\[])+", css)]


def _column_of(css: str) -> str:
    """The column that ``with_selectors`` puts a selector with combinators in."""
    return "selects_" + hashlib.md5(css.encode()).hexdigest()


def selects(css: str) -> Column:
    """Whether a node matches one of the selectors between commas: tag, .class, #id, [name], [name=value] and the forms
    *=, ^= and $=. Selectors with combinators look at other nodes, so nodes must have gone through ``with_selectors``."""
    return either([_compound(x) if len(_steps(x)) == 1 else F.col(_column_of(x)) for x in _alternatives(css)])


def with_selectors(nodes: DataFrame, selectors: Iterable[str]) -> DataFrame:
    """Nodes with a column for each selector with combinators: descendants (a blank), children (>), next siblings (+) and
    later siblings (~). A descendant's ancestors are found by a running maximum of their ends in order of ``pos``, siblings by
    a window over those of one parent, and children by joining the parents that match."""
    before = W.partitionBy("page_key").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    siblings = W.partitionBy("page_key", "parent").orderBy("pos")
    for css in dict.fromkeys(x for s in selectors for x in _alternatives(s)):
        steps, out = _steps(css), _column_of(css)
        first = _compound(steps[0][1])
        if len(steps) == 1 or out in nodes.columns:
            continue
        nodes = nodes.withColumn(out, first)
        for how, compound in steps[1:]:
            held, own = F.col(out), _compound(compound)
            if how == ">":
                parents = nodes.where(held).select("page_key", F.col("pos").alias("parent"), F.lit(True).alias("parent_matches"))
                nodes = nodes.join(parents, ["page_key", "parent"], "left").withColumn(out, own & F.coalesce("parent_matches", F.lit(False))).drop("parent_matches")
                continue
            if how == " ":
                found = F.max(F.when(held, F.col("sub_end"))).over(before) >= F.col("pos")
            elif how == "+":
                found = F.lag(held).over(siblings)
            else:
                found = F.max(held).over(siblings.rowsBetween(W.unboundedPreceding, -1))
            # Nodes without a parent have no siblings.
            found = found if how == " " else found & F.col("parent").isNotNull()
            nodes = nodes.withColumn(out, own & F.coalesce(found, F.lit(False)))
    return nodes


def closest(nodes: DataFrame, css: str, name: str = "closest") -> DataFrame:
    """Nodes with ``name``: the position of the nearest node at or above that matches, null where none does."""
    df = with_selectors(nodes, [css])
    marked = df.where(selects(css)).select("page_key", F.col("pos").alias("top_pos"), F.col("sub_end").alias("top_end"))
    within = df.select("page_key", "pos").join(marked, "page_key").where("pos between top_pos and top_end")
    nearest = within.groupBy("page_key", "pos").agg(F.max("top_pos").alias(name))
    return nodes.join(nearest, ["page_key", "pos"], "left")


@dataclass(frozen=True)
class NodeRule:
    """Tag and role must match where given; then any of the patterns, and without patterns the node matches."""

    tag: str | None = None
    role: str | None = None
    class_pattern: str | None = None
    id_pattern: str | None = None
    check: Callable[[], Column] | None = None

    def matches(self) -> Column:
        tests = [F.lower(attr(k)).rlike(p) for k, p in (("class", self.class_pattern), ("id", self.id_pattern)) if p]
        tests += [self.check()] if self.check else []
        out = either(tests) if tests else F.lit(True)
        for name, column in (("tag", F.col("tag")), ("role", attr("role"))):
            if value := getattr(self, name):
                out = (column == value) & out
        return out


def any_rule(rules: Sequence[NodeRule]) -> Column:
    return either([r.matches() for r in rules])


@dataclass(frozen=True)
class SiteRule:
    """What one host needs: subtrees to skip, texts to skip, the root of its articles, and what a prompt adds."""

    host: str
    skip_selectors: tuple[str, ...] = ()
    skip_texts: tuple[str, ...] = ()
    root_selector: str | None = None
    terms: dict[str, str] = field(default_factory=dict)
    instructions: str = ""

    def prompt(self) -> str:
        """The terms as JSON, then the instructions."""
        terms = [f'"document_terms":{json.dumps(self.terms, indent=2, ensure_ascii=False)}'] if self.terms else []
        return "\n".join(terms + [self.instructions] * bool(self.instructions))


def host_matches(host: Column, pattern: str) -> Column:
    """The host itself, or with ``*.`` before it any host below it too."""
    if pattern.startswith("*."):
        return (host == pattern[2:]) | host.endswith(pattern[1:])
    return host == pattern


def by_site(url: Column, rules: Sequence[SiteRule], value: Callable[[SiteRule], Column], default: Column) -> Column:
    """``value`` of the first rule whose host matches."""
    out, host = None, url_host(url)
    for r in rules:
        found = host_matches(host, r.host)
        out = F.when(found, value(r)) if out is None else out.when(found, value(r))
    return default if out is None else out.otherwise(default)
