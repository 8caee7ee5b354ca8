"""Text normalisation: declarative per-locale pipelines of seven operations, compiled to Column expressions.

Each operation exists twice with one meaning: as a Column builder for tables and as a Python function for query texts,
which are folded on the driver. Only mapSequences needs a UDF.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .rulesets import SHIPPED

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(UPPER, LOWER)
_SHIELD = ""

#: Unicode categories by their long names; Format is refused, as it would take joiners that carry meaning.
CATEGORIES = {
    "UppercaseLetter": "Lu", "LowercaseLetter": "Ll", "TitlecaseLetter": "Lt", "ModifierLetter": "Lm", "OtherLetter": "Lo",
    "NonSpacingMark": "Mn", "SpacingCombiningMark": "Mc", "EnclosingMark": "Me", "DecimalDigitNumber": "Nd", "LetterNumber": "Nl",
    "OtherNumber": "No", "SpaceSeparator": "Zs", "LineSeparator": "Zl", "ParagraphSeparator": "Zp", "Control": "Cc",
    "ConnectorPunctuation": "Pc", "DashPunctuation": "Pd", "OpenPunctuation": "Ps", "ClosePunctuation": "Pe", "InitialQuotePunctuation": "Pi",
    "FinalQuotePunctuation": "Pf", "OtherPunctuation": "Po", "MathSymbol": "Sm", "CurrencySymbol": "Sc", "ModifierSymbol": "Sk", "OtherSymbol": "So",
}


class RuleError(ValueError):
    """A rule set that can't be used; the message names every fault."""


# --- Column builders ---------------------------------------------------------------------------------------------


def map_chars(col: Column, table: dict[str, str]) -> Column:
    """Each character to its replacement, in one pass: what was put in is not mapped again."""
    if all(len(v) <= 1 for v in table.values()):
        keys = sorted(table, key=lambda k: table[k] == "")  # translate() drops what has no counterpart
        return F.translate(col, "".join(keys), "".join(table[k] for k in keys))
    if not set("".join(table.values())) & set(table):
        return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), table.items(), col)
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(F.split(col, ""), lambda c: F.coalesce(F.element_at(pairs, c), c)), "")


def map_sequences(col: Column, table: dict[str, str]) -> Column:
    """Longest match first, left to right; what was put in is not looked at again."""
    fold = sequence_mapper(table)

    @arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fold(t) for t in texts.to_pylist()], pa.string())

    return run(col)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def lower_simple(col: Column) -> Column:
    """Lower case, one character for one: no final sigma; the dotted capital I stays, as it has no such form."""
    return F.translate(F.lower(F.translate(col, "İΣ", f"{_SHIELD}σ")), _SHIELD, "İ")


def strip_categories(col: Column, names: list[str]) -> Column:
    return F.regexp_replace(col, "[" + "".join(rf"\p{{{CATEGORIES[n]}}}" for n in names) + "]", "")


def collapse_whitespace(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def drop_tokens(col: Column, tokens: list[str]) -> Column:
    """Whole tokens between white space go; the rest is joined by one space."""
    return F.array_join(F.filter(F.split(collapse_whitespace(col), " "), lambda t: ~t.isin(list(tokens))), " ")


def prefixes(col: Column, n: int) -> Column:
    """Distinct first n characters of the tokens longer than n, in order of appearance."""
    if n <= 0:
        return F.lit("")
    longer = F.filter(F.split(collapse_whitespace(col), " "), lambda t: F.length(t) > n)
    return F.array_join(F.array_distinct(F.transform(longer, lambda t: F.substring(t, 1, n))), " ")


# --- the same in Python ------------------------------------------------------------------------------------------


def sequence_mapper(table: dict[str, str]) -> Callable[[str], str]:
    pattern = re.compile("|".join(re.escape(k) for k in sorted(table, key=len, reverse=True)))
    return lambda text: pattern.sub(lambda m: table[m[0]], text)


def _lower_simple(text: str) -> str:
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _collapse(text: str) -> str:
    return " ".join(text.split())


# --- rule sets ---------------------------------------------------------------------------------------------------

_Both = tuple[Callable[[Column], Column], Callable[[str], str]]


def _operation(op: dict) -> _Both:
    kind = op.get("op")
    if kind == "mapChars":
        table = op.get("map") or {}
        bad = [k for k in table if len(k) != 1]
        if not table or bad:
            raise RuleError(f"mapChars takes single characters; got {bad or 'none'}")
        codes = str.maketrans(table)
        return lambda c: map_chars(c, table), lambda t: t.translate(codes)
    if kind == "mapSequences":
        table = op.get("map") or {}
        if not table or "" in table:
            raise RuleError("mapSequences takes non-empty sequences")
        return lambda c: map_sequences(c, table), sequence_mapper(table)
    if kind == "lowercase":
        if op.get("mode") == "ascii":
            return lower_ascii, lambda t: t.translate(_ASCII_LOWER)
        if op.get("mode") == "invariant":
            return lower_simple, _lower_simple
        raise RuleError(f"lowercase has no mode {op.get('mode')!r}")
    if kind == "stripUnicodeCategory":
        names = op.get("categories") or []
        bad = [n for n in names if n not in CATEGORIES]
        if not names or bad:
            raise RuleError(f"stripUnicodeCategory can't take {bad or 'no category'}")
        codes = {CATEGORIES[n] for n in names}
        return lambda c: strip_categories(c, names), lambda t: "".join(x for x in t if unicodedata.category(x) not in codes)
    if kind == "collapseWhitespace":
        return collapse_whitespace, _collapse
    if kind == "dropTokens":
        tokens = op.get("tokens") or []
        if not tokens or any(not t or t.split() != [t] for t in tokens):
            raise RuleError("dropTokens takes whole tokens without white space")
        dropped = set(tokens)
        return lambda c: drop_tokens(c, tokens), lambda t: " ".join(x for x in t.split() if x not in dropped)
    if kind == "normalizeForm":
        raise RuleError("normalizeForm is not available: results would depend on the runtime's Unicode tables")
    raise RuleError(f"no operation {kind!r}")


def canonical(ops: list[dict]) -> str:
    """The pipeline as JSON with sorted keys, maps and lists; comments, descriptions and self tests aside."""
    keep = ("op", "form", "map", "mode", "categories", "tokens")
    return json.dumps([{k: sorted(v) if isinstance(v, list) else v for k, v in op.items() if k in keep and v is not None} for op in ops], sort_keys=True, ensure_ascii=False, separators=(",", ":"))


@dataclass
class RuleSet:
    """A compiled rule set."""

    tag: str
    ops: list[dict]
    config: str | None = None
    prefix: int = 0
    self_test: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        faults = []
        if self.config is not None and not re.fullmatch(r"[A-Za-z0-9_]+", self.config):
            faults.append(f"searchConfig {self.config!r}")
        if self.prefix and not 3 <= self.prefix <= 8:
            faults.append(f"stemPrefixLength {self.prefix} is neither 0 nor 3 to 8")
        if len(self.self_test) < 3:
            faults.append("fewer than 3 self tests")
        self._steps: list[_Both] = []
        for op in self.ops:
            try:
                self._steps.append(_operation(op))
            except RuleError as e:
                faults.append(str(e))
        if not faults:
            faults += [f"{t['in']!r} gives {got!r}, not {t['out']!r}" for t in self.self_test if (got := self.normalise(t["in"])) != t["out"]]
        if faults:
            raise RuleError(f"rule set {self.tag}: " + "; ".join(faults))

    @classmethod
    def of(cls, spec: dict) -> RuleSet:
        return cls(spec["tag"], spec.get("pipeline") or [], spec.get("searchConfig"), spec.get("stemPrefixLength") or 0, spec.get("selfTest") or [])

    def normalise(self, text: str | None) -> str:
        return reduce(lambda t, s: s[1](t), self._steps, text or "")

    def column(self, col: Column) -> Column:
        return reduce(lambda c, s: s[0](c), self._steps, F.coalesce(col, F.lit("")))

    def prefixes(self, normalised: str) -> str:
        return " ".join(dict.fromkeys(t[: self.prefix] for t in normalised.split() if len(t) > self.prefix)) if self.prefix else ""

    def prefix_column(self, normalised: Column) -> Column:
        return prefixes(normalised, self.prefix)

    @property
    def hash(self) -> str:
        parts = [canonical(self.ops), *([f"cfg={self.config}"] if self.config else []), *([f"pfx={self.prefix}"] if self.prefix else [])]
        return hashlib.sha256("|".join(parts).encode()).hexdigest()


class Registry:
    """Rule sets by tag; a locale resolves to its longest prefix on '-' segments, else to the fallback '*'."""

    def __init__(self, specs: list[dict] | None = None, overlay: list[dict] | None = None):
        chosen: dict[str, dict] = {}
        for source in (SHIPPED if specs is None else specs), overlay or []:
            tags = [s["tag"] for s in source]
            if twice := {t for t in tags if tags.count(t) > 1}:
                raise RuleError(f"tags given twice: {sorted(twice)}")
            chosen |= {s["tag"]: s for s in source}
        if "*" not in chosen:
            raise RuleError("no fallback rule set '*'")
        faults, self.sets = [], {}
        for tag, spec in sorted(chosen.items()):
            try:
                self.sets[tag] = RuleSet.of(spec)
            except RuleError as e:
                faults.append(str(e))
        if faults:
            raise RuleError(" | ".join(faults))

    @classmethod
    def from_directory(cls, path: str) -> Registry:
        return cls(overlay=[json.loads(p.read_text("utf-8")) for p in sorted(Path(path).glob("*.json"))])

    def resolve(self, locale: str | None) -> RuleSet:
        parts = (locale or "").split("-")
        return next((self.sets[t] for n in range(len(parts), 0, -1) if (t := "-".join(parts[:n])) in self.sets), self.sets["*"])

    def by_locale(self, locale: Column, build: Callable[[RuleSet], Column]) -> Column:
        """One expression that applies to each row the rule set its locale resolves to."""
        out = build(self.sets["*"])
        for tag in sorted((t for t in self.sets if t != "*"), key=len):  # longer tags are tried first
            out = F.when((locale == tag) | locale.startswith(f"{tag}-"), build(self.sets[tag])).otherwise(out)
        return out

    def describe(self) -> list[dict]:
        return [
            {"tag": t, "hash": s.hash, "operations": [o["op"] for o in s.ops], "search_config": s.config or "simple", "prefix_length": s.prefix, "dropped_tokens": sum(len(o.get("tokens") or []) for o in s.ops)}
            for t, s in sorted(self.sets.items())
        ]
