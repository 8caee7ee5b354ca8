"""API keys and scopes."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass

from .errors import Forbidden

#: What a scope includes.
SCOPES = {"read": {"read"}, "write": {"read", "write"}, "admin": {"read", "write", "admin"}}


@dataclass(frozen=True)
class Principal:
    tenant: str
    scopes: frozenset[str]
    fingerprint: str

    def require(self, scope: str) -> None:
        if scope not in self.scopes:
            raise Forbidden(f"scope {scope!r} is needed")


def parse_keys(text: str) -> list[tuple[str, str, frozenset[str]]]:
    """`tenant:key[:scope+scope]` entries between commas; without scopes a key may read and write."""
    out = []
    for entry in filter(None, (e.strip() for e in text.split(","))):
        parts = entry.split(":")
        if not 2 <= len(parts) <= 3 or not parts[0] or not parts[1]:
            raise ValueError("a key is tenant:key or tenant:key:scopes")
        names = parts[2].split("+") if len(parts) == 3 else ["write"]
        if bad := [n for n in names if n not in SCOPES]:
            raise ValueError(f"no scope {bad}")
        out.append((parts[0], parts[1], frozenset().union(*(SCOPES[n] for n in names))))
    return out


def authenticate(presented: str, keys: list[tuple[str, str, frozenset[str]]]) -> Principal | None:
    """Compares with every key in constant time; the tenant comes from the key and from nothing else."""
    found = None
    for tenant, key, scopes in keys:
        if hmac.compare_digest(presented.encode(), key.encode()):
            found = Principal(tenant, scopes, hashlib.sha256(key.encode()).hexdigest()[:16])
    return found
