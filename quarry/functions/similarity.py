"""Ratcliff-Obershelp similarity with the close-match rules of ``difflib``.

Resolution is: exact, then case-insensitive, then the best candidate whose
score ``2*M/T`` reaches the cutoff (ties go to the larger string), else an
error.  The score is *not* an edit distance, so it cannot be swapped for
Spark's ``levenshtein``; the per-pair scoring stays a tiny Python helper
while Spark does the candidate generation, grouping and top-1 reduction.
"""

from __future__ import annotations

from difflib import SequenceMatcher

# Fixed value that must agree with the reference's close-match cutoff.
CUTOFF = 0.6


def length_bound_ok(la: int, lb: int, cutoff: float = CUTOFF) -> bool:
    """Upper bound of the score from lengths alone (difflib's real_quick_ratio)."""
    t = la + lb
    return t > 0 and 2.0 * min(la, lb) / t >= cutoff


def score(needle: str, candidate: str, cutoff: float = CUTOFF) -> float | None:
    """Score ``candidate`` against ``needle`` as difflib's close-match does.

    Returns ``None`` when any of the three staged ratios is below cutoff.
    ``needle`` is sequence 2 (the one difflib indexes), as in close-match.
    """
    sm = SequenceMatcher(None, candidate, needle)
    if sm.real_quick_ratio() >= cutoff and sm.quick_ratio() >= cutoff:
        r = sm.ratio()
        if r >= cutoff:
            return r
    return None


class NotFound(ValueError):
    """Raised when a name or value has no exact, case or close match."""


def resolve_name(needle: str, haystack: list[str], label: str = "value",
                 cutoff: float = CUTOFF) -> tuple[str, str, float]:
    """Resolve a name against a small driver-side list (tables, columns).

    Returns ``(canonical, kind, score)`` with kind in exact/case/fuzzy.
    Only metadata (table and column names) goes through here; data values
    are resolved by Spark jobs in :mod:`quarry.operators.resolve`.
    """
    if needle in haystack:
        return needle, "exact", 1.0
    lower_map: dict[str, str] = {}
    for h in haystack:  # last spelling wins on case collisions
        lower_map[h.lower()] = h
    low = needle.lower()
    if low in lower_map:
        return lower_map[low], "case", 1.0
    best: tuple[float, str] | None = None
    for cand in lower_map:
        s = score(low, cand, cutoff)
        if s is not None and (best is None or (s, cand) > best):
            best = (s, cand)
    if best is not None:
        return lower_map[best[1]], "fuzzy", best[0]
    shown = sorted(haystack)[:50]
    more = "" if len(haystack) <= 50 else f" (+{len(haystack) - 50} more)"
    raise NotFound(f"{label} '{needle}' not found. Available: {shown}{more}")
