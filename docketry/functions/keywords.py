"""Driver-side keyword extraction from a technology phrase (one scalar per query)."""

from __future__ import annotations

import re

from docketry.config import ScoringConfig


def _stem(word: str, cfg: ScoringConfig) -> str:
    """Drop the first listed suffix that leaves at least two characters; once only."""
    fits = (s for s in cfg.verb_endings + cfg.particles if word.endswith(s) and len(word) >= len(s) + 2)
    suffix = next(fits, "")
    return word[: len(word) - len(suffix)]


def keywords(technology: str, cfg: ScoringConfig | None = None) -> list[str]:
    """Distinct literal keywords of the phrase, in order of first appearance."""
    cfg = cfg or ScoringConfig()
    stems = (_stem(w, cfg) for w in re.findall(r"\w+", (technology or "").casefold()))
    wanted = (
        s for s in stems if len(s) > 1 and s not in cfg.stop_words and re.search("[A-Za-z가-힣]", s)
    )
    return list(dict.fromkeys(wanted))


def targets(technology: str, cfg: ScoringConfig) -> list[str]:
    """Concept groups that the technology phrase names."""
    text = (technology or "").casefold()
    return [g for g, phrases in cfg.groups.items() if any(p.casefold() in text for p in phrases)]
