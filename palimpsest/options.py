"""Settings of a comparison, passed explicitly to every operator that needs them."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CompareOptions:
    ignore_case: bool = False
    ignore_ws: bool = True
    precision: str = "word"  # or "char"
    formatting: bool = True
    detect_moves: bool = True
    keep_empty: bool = False
    norm_punct: bool = False
    norm_quotes: bool = True
    merge_paras: bool = True
    by_position: bool = False  # pair the blocks of a gap by their place, not by the best total similarity

    def plain(self) -> "CompareOptions":
        """Plain-text and recognised-text comparison: no formatting, empty lines stay."""
        return replace(self, formatting=False, keep_empty=True, merge_paras=False)


@dataclass(frozen=True)
class RiskOptions:
    money: bool = True
    date: bool = True
    keywords: tuple[str, ...] = ("damages", "indemnity", "liability", "termination")


# Fixed limits of the pairing step.
PAIR_MIN_DICE = 0.3
SPLIT_MIN = 0.8
SPLIT_MAX_PARTS = 4

# Fixed limits of version matching.
MATCH_MIN = 0.5
TIE_GAP = 0.02
MIN_FP_CHARS = 4

# Fixed section order.
SECTIONS = ("header", "body", "footnote", "footer")
