"""The amino alphabet: fixed values of the public format."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# Symbols in code order, and the members of the degenerate ones.
SYMBOLS = "ACDEFGHIKLMNPQRSTVWY-BJZOUX*~"
CANONICAL = 20
MEMBERS = {"B": "DN", "J": "IL", "Z": "EQ", "O": "K", "U": "C", "X": "ACDEFGHIKLMNPQRSTVWY"}
CODES = np.full(256, 255, dtype=np.uint8)
for _i, _c in enumerate(SYMBOLS):
    CODES[ord(_c)] = _i
BACKGROUND = np.full(CANONICAL, 0.05)


def alphabet(spark: SparkSession) -> DataFrame:
    """code, symbol, members (canonical symbols that it stands for; none for gaps)."""
    rows = [(i, c, list(c) if i < CANONICAL else list(MEMBERS.get(c, ""))) for i, c in enumerate(SYMBOLS)]
    return spark.createDataFrame(rows, "code int, symbol string, members array<string>")


def expand(odds: np.ndarray) -> np.ndarray:
    """Columns for all 29 codes from those of the 20 canonical ones: degenerate ones by background-weighted mean, gaps 1."""
    out = np.ones((*odds.shape[:-1], len(SYMBOLS)))
    out[..., :CANONICAL] = odds
    for c, members in MEMBERS.items():
        at = [SYMBOLS.index(m) for m in members]
        out[..., SYMBOLS.index(c)] = (odds[..., at] * BACKGROUND[at]).sum(axis=-1) / BACKGROUND[at].sum()
    return out


def digits(residues: str) -> np.ndarray:
    codes = CODES[np.frombuffer(residues.encode("latin-1"), dtype=np.uint8)]
    if len(codes) and codes.max() == 255:
        raise ValueError("a residue is outside the alphabet")
    return codes
