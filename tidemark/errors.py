"""Error codes by area, as columns and exceptions carry them."""

from __future__ import annotations

#: Prefix of a code by area.
AREAS = {
    "MD": "market data", "AC": "annual cycle", "QS": "spectrum", "CL": "composite line", "PH": "analogies",
    "COT": "positioning", "BT": "backtest", "RM": "risk", "LN": "lineage",
}


class AnalysisError(ValueError):
    """An error with a code such as ``RM002``."""

    def __init__(self, code: str, message: str) -> None:
        area = code.rstrip("0123456789")
        if area not in AREAS:
            raise ValueError(f"unknown area: {code}")
        super().__init__(f"{code} ({AREAS[area]}): {message}")
        self.code = code
