"""Locales, synonyms, tokens, hashes, identifiers, similarity and small predicates."""

from __future__ import annotations

import hashlib
import math
import re
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalise import lower_ascii

UNIT = "\x1f"

# --- locales -----------------------------------------------------------------------------------------------------

LOCALE = r"^[a-z]{2,3}(-[a-z0-9]{2,8})*$"


def normalise_locale(tag: str | None) -> str:
    return (tag or "").strip().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ_", "abcdefghijklmnopqrstuvwxyz-"))


def is_locale(tag: str) -> bool:
    return len(tag) <= 35 and re.fullmatch(LOCALE[1:-1], tag) is not None


def locale_column(col: Column) -> Column:
    return F.translate(lower_ascii(F.trim(col)), "_", "-")


def is_locale_column(col: Column) -> Column:
    return (F.length(col) <= 35) & col.rlike(LOCALE)


def locale_chain(locale: str | None, fallback: dict[str, list[str]]) -> list[str]:
    """The locale, then its direct fallbacks; nothing for no locale."""
    tag = normalise_locale(locale)
    return list(dict.fromkeys([tag, *map(normalise_locale, fallback.get(tag, []))])) if tag else []


def fallback_cycles(fallback: dict[str, list[str]]) -> list[list[str]]:
    """Each cycle of the fallback graph once, from its smallest member."""
    found: set[tuple[str, ...]] = set()

    def walk(at: str, path: list[str]) -> None:
        if at in path:
            ring = path[path.index(at) :]
            least = ring.index(min(ring))
            found.add(tuple(ring[least:] + ring[:least]))
            return
        for to in fallback.get(at, []):
            walk(to, [*path, at])

    for start in fallback:
        walk(start, [])
    return [list(r) for r in sorted(found)]


# --- synonyms ----------------------------------------------------------------------------------------------------


def expand(query: str, chain: list[str], groups: dict[str, list[list[str]]]) -> list[str]:
    """Members that a query's synonym groups add: a group fires if a member occurs as a run of whole tokens."""
    padded, added = f" {' '.join(query.split())} ", []
    for locale in chain:
        for group in groups.get(locale, []):
            if any(f" {m} " in padded for m in group):
                added += [m for m in group if f" {m} " not in padded and m not in added]
    return added


def expand_column(folded: Column, group: list[str]) -> Column:
    """expand() for one group over a column: the added members as an array."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.trim(folded), " +", " "), F.lit(" "))
    has = [F.contains(padded, F.lit(f" {m} ")) for m in group]
    fires = F.array_contains(F.array(*has), True)
    return F.array_compact(F.array(*[F.when(fires & ~h, F.lit(m)) for m, h in zip(group, has, strict=True)]))


# --- tokens ------------------------------------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}]+"


def tokens(col: Column) -> Column:
    """Runs of letters and digits, in order."""
    return F.regexp_extract_all(col, F.lit(f"({WORD})"), 1)


def python_tokens(text: str) -> list[str]:
    out, run = [], []
    for c in text + " ":
        if c.isalnum():
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return out


def estimate_tokens(col: Column, chars_per_token: float = 3.5) -> Column:
    return F.ceil(F.length(col) / F.lit(float(chars_per_token))).cast("int")


# --- hashes ------------------------------------------------------------------------------------------------------


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def document_hash(title: Column, content: Column) -> Column:
    return sha(F.length(title).cast("string"), F.lit(UNIT), title, content)


def chunk_hash(path: Column, body: Column) -> Column:
    return sha(F.array_join(path, UNIT), F.lit("\n"), body)


def embedding_key(normalised: Column) -> Column:
    return sha(F.lit("chunk"), normalised)


def query_key(text: Column) -> Column:
    return sha(F.lit("query"), text)


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(UNIT, *parts).cast("binary"), 256)


def fnv1a64(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


# --- identifiers -------------------------------------------------------------------------------------------------


def model_slug(col: Column) -> Column:
    return F.substring(F.btrim(F.regexp_replace(lower_ascii(col), "[^a-z0-9]+", "_"), F.lit("_")), 1, 40)


def python_model_slug(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).strip("_")[:40]


def is_sql_identifier(col: Column) -> Column:
    return col.rlike("^[a-z_][a-z0-9_]{0,62}$")


def is_correlation_id(col: Column) -> Column:
    return col.rlike("^[A-Za-z0-9\\-_.:]{1,128}$")


def has_nul(col: Column) -> Column:
    return F.contains(col, F.lit("\x00"))


def json_has_nul(col: Column) -> Column:
    """JSON text with U+0000 written out: an odd number of backslashes before u0000."""
    return col.rlike(r"(^|[^\\])(\\\\)*\\u0000")


# --- similarity --------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hash_embed(text: str, dim: int) -> list[float]:
    """Signed feature hashing of letter and digit runs, of length one; no token: the first unit vector."""
    out = [0.0] * dim
    for t in python_tokens(text):
        h = hashlib.sha256(t.encode()).digest()
        out[struct.unpack("<I", h[:4])[0] % dim] += 1.0 if h[4] % 2 == 0 else -1.0
    n = math.sqrt(sum(x * x for x in out))
    if not n:
        return [1.0] + [0.0] * (dim - 1)
    return [x / n for x in out]


def token_bucket(token: Column, dim: int) -> Column:
    h = F.sha2(token.cast("binary"), 256)
    le = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.conv(le, 16, 10).cast("long") % dim


def token_sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.sha2(token.cast("binary"), 256), 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def trigrams(word: str) -> list[str]:
    padded = f"  {word.lower()} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def word_similarity(term: str, content: str, least: float = 0.0, known: dict[str, list[str]] | None = None) -> float:
    """Largest share of the term's trigrams in common with a stretch of the content's trigrams; 0 if it is under `least`.

    As of trigram extents: for each pair of first and last matching trigram, common / (term + extent - common). An extent of
    more distinct trigrams than term / least can't reach it, so the work is linear in the content where `least` is set.
    known: trigrams of words seen before.
    """
    want = {g for w in python_tokens(term) for g in trigrams(w)}
    if not want:
        return 0.0
    known = {} if known is None else known
    have: list[str] = []
    for w in python_tokens(content):
        if w not in known:
            known[w] = trigrams(w)
        have += known[w]
    at = [i for i, g in enumerate(have) if g in want]
    best = max(0.0, least - 1e-12)
    for n, first in enumerate(at):
        common: set[str] = set()
        extent: set[str] = set()
        done = first
        for last in at[n:]:
            extent.update(have[done : last + 1])
            done = last + 1
            common.add(have[last])
            best = max(best, len(common) / (len(want) + len(extent) - len(common)))
            if len(want) / max(1, len(extent)) <= best:
                break  # a longer extent can't do better
    return best if best >= least else 0.0


def vector_literal(v: Column) -> Column:
    """[a,b,…]; an empty vector, and one with a null or a number that isn't finite, is an error."""
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(v.isNull(), F.lit(None).cast("string")).when(good, F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))).otherwise(F.raise_error(F.lit("a vector has finite numbers, one at least")))


def encode_vector(v: list[float]) -> bytes:
    return struct.pack(f"<{len(v)}f", *v)


def decode_vector(data: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(data) // 4}f", data))
