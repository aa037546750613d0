"""Counts of characters, words, lines and repeats of whole texts: the rule statistics and the features made from them."""

from __future__ import annotations

import numpy as np
import pandas as pd

from snipscan.llm.textwords import U64, Words, chunks, mix

#: Byte classes. Fixed values.
SYMBOLS = b"#*$%&|<>"
_CLASS = {"other": 0, "space": 1, "upper": 2, "lower": 3, "digit": 4, "symbol": 5, "bang": 6, "stop": 7, "lead": 8, "tail": 9, "pipe": 10}


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = bytes([b])
        if c == b"|":
            k = "pipe"
        elif c in SYMBOLS:
            k = "symbol"
        elif c.isspace():
            k = "space"
        elif c == b"!":
            k = "bang"
        elif c in b".,;:?":
            k = "stop"
        elif c.isdigit():
            k = "digit"
        elif c.isalpha():
            k = "upper" if c.isupper() else "lower"
        elif b >= 0xC0:
            k = "lead"
        elif b >= 0x80:
            k = "tail"
        else:
            k = "other"
        table[b] = _CLASS[k]
    return table


CLASS_OF = _class_table()
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_distinct_grams", "n_upper", "n_lower", "n_digit", "n_bang", "n_stop", "n_pipe", "n_chars", "n_wide"]


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys of each document, times that each row's key stands in its document)."""
    if not len(key):
        return np.zeros(n, np.int64), np.zeros(0, np.int64)
    _, first, inverse, times = np.unique(key ^ mix(doc.astype(U64) + U64(1)), return_index=True, return_inverse=True, return_counts=True)
    return np.bincount(doc[first], minlength=n), times[inverse]


def _counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    words = Words(texts)
    n = words.n
    by = np.repeat(np.arange(n) * 16, words.text_end - words.text_start) + CLASS_OF[words.buf]
    of = np.bincount(by, minlength=16 * n).reshape(n, 16)
    c = {k: of[:, v] for k, v in _CLASS.items()}
    bytes_in = np.fromiter(map(len, texts), np.int64, n)
    h = words.hashes()
    distinct, _ = _distinct(words.doc, h, n)
    at, gram = words.grams(h, 3)
    grams, times = _distinct(words.doc[at], gram, n)
    hit = np.zeros(len(h) + 2, bool)
    for j in range(3):
        hit[at[times >= 2] + j] = True
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, x in enumerate(texts):
        rows = [r for r in x.split(b"\n") if r.strip()]
        lines[i], dup[i] = len(rows), len(rows) - len(set(rows))
    space = c["space"] - 1  # the newline put after each text
    return {
        "n_words": words.count, "word_chars": bytes_in - c["tail"] - space, "n_symbols": c["symbol"] + c["pipe"], "n_dup_lines": dup,
        "n_repeat_words": np.bincount(words.doc, weights=hit[: len(h)], minlength=n).astype(np.int64), "n_lines": lines, "n_distinct_words": distinct,
        "n_distinct_grams": grams, "n_upper": c["upper"], "n_lower": c["lower"], "n_digit": c["digit"], "n_bang": c["bang"], "n_stop": c["stop"], "n_pipe": c["pipe"],
        "n_chars": bytes_in - c["tail"], "n_wide": c["lead"],
    }


def text_counts(texts: list[bytes]) -> pd.DataFrame:
    """A row of COUNTS for each text; all zero for an empty one.

    n_repeat_words counts words within a window of three words that stands twice or more in the text; n_dup_lines counts
    lines with a word that equal an earlier line of the text.
    """
    parts = [pd.DataFrame(_counts(texts[lo:hi])) for lo, hi in chunks(texts)]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({k: np.zeros(0, np.int64) for k in COUNTS})


FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bang_share", "stop_share", "pipe_share", "distinct_share", "gram_share", "line_words", "wide_share"]


def features(counts: pd.DataFrame) -> np.ndarray:
    """One row of FEATURES for each row of counts, finite for empty texts too."""
    c = {k: counts[k].to_numpy(np.float64) for k in counts}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    letters = np.maximum(c["n_upper"] + c["n_lower"], 1)
    columns = [
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words,
        c["n_upper"] / letters, c["n_digit"] / chars, c["n_bang"] / words, c["n_stop"] / words, c["n_pipe"] / words, c["n_distinct_words"] / words ** 0.9,
        c["n_distinct_grams"] / np.maximum(words - 2, 1), np.log1p(c["n_words"] / np.maximum(c["n_lines"], 1)), c["n_wide"] / chars,
    ]
    return np.column_stack(columns)
