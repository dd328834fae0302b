"""Answer normalisation, scoring and text metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"


def normalize_answer(text: Column, articles: str = r"(?U)\b(a|an|the)\b") -> Column:
    """Lower case, without punctuation and articles, single spaces."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, ""), articles, " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def exact_match(pred: Column, golds: Column) -> Column:
    p = normalize_answer(pred)
    return F.exists(golds, lambda g: normalize_answer(g) == p).cast("int")


def sub_match(pred: Column, golds: Column) -> Column:
    p = normalize_answer(pred)
    return F.exists(golds, lambda g: p.contains(normalize_answer(g))).cast("int")


def tag_count(text: Column, tag: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(tag), F.lit("")))) / len(tag)).cast("int")


def answer_score(pred: Column, golds: Column, text: Column, most: int = 10) -> Column:
    """Exact match of the extracted answer; a quarter of it if the text holds too many answer tags; 0 without one."""
    hit = exact_match(pred, golds).cast("double")
    return F.when(pred.isNull(), 0.0).when(tag_count(text, "<answer>") > most, hit / 4).otherwise(hit)


def final_number(text: Column, tail: int = 300, strict: bool = True) -> Column:
    """The number after the last `####` (strict), or the last number, of the text's end; commas go."""
    end = F.right(text, F.lit(tail))
    pattern = r"#### (-?[0-9.,]+)" if strict else r"(-?[0-9][0-9.,]*)"
    found = F.regexp_extract_all(end, F.lit(pattern), F.lit(1))
    last = F.when(F.size(found) > 0, F.element_at(found, -1))
    return F.regexp_replace(F.replace(last, F.lit(","), F.lit("")), r"\.$", "")


def completion_clean(text: Column) -> Column:
    """Strip, drop bracketed parts, turn double spaces to single ones once."""
    out = F.replace(F.trim(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(out, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def number_key(value: Column) -> Column:
    """0.5 as 0p5, a minus as neg."""
    return F.replace(F.replace(value.cast("string"), F.lit("-"), F.lit("neg")), F.lit("."), F.lit("p"))


def dispatch_score(source: Column, rules: dict[str, Column]) -> Column:
    """The rule of the row's data source; an unknown source is an error."""
    out = F.when(F.lit(False), F.lit(0.0))
    for name, rule in rules.items():
        out = out.when(source == name, rule)
    return out.otherwise(F.raise_error(F.concat(F.lit("no score for data source "), source)).cast("double"))


def _boxed(text: str | None) -> str | None:
    """Content of the last \\boxed{...}, by matching braces."""
    at = (text or "").rfind("\\boxed{")
    if at < 0:
        return None
    depth = 0
    for i in range(at + 6, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return text[at + 7 : i]
    return None


@F.pandas_udf(T.StringType())
def boxed_answer(text: pd.Series) -> pd.Series:
    return text.map(_boxed)


def latex_plain(text: Column) -> Column:
    """A plain form of a LaTeX answer for comparison."""
    out = F.regexp_replace(text, r"\\(?:left|right|!|,|;|quad|text|mathrm|mbox)|\^\{?\\circ\}?|\\%|%|\$|\s", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\\[td]frac", r"\\\\frac"), r"\\frac([0-9])([0-9])", r"\\\\frac{$1}{$2}")
    return F.regexp_replace(F.regexp_replace(out, r"^([0-9]+)/([0-9]+)$", r"\\\\frac{$1}{$2}"), r"^0?\.", "0.")


def _tokens(texts: pd.Series) -> tuple[pa.Array, np.ndarray]:
    """White-space tokens of all texts, and how many each text has; a null text has none."""
    lists = pc.utf8_split_whitespace(pc.fill_null(pa.array(texts, pa.large_string()), ""))
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    full = np.asarray(pc.not_equal(flat, ""))
    return flat.filter(pa.array(full)), np.bincount(row[full], minlength=len(lists))


def _shared(one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    """Per row the size of the multiset intersection; one, two: (row, item) packed with `row` above the low 32 bits."""
    (a, i), (b, j) = (np.unique(x, return_counts=True) for x in (one, two))
    both, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return np.bincount(both >> 32, weights=np.minimum(i[at], j[to]), minlength=n)


def _grams(code: np.ndarray, size: np.ndarray, most: int) -> list[np.ndarray]:
    """Packed (row, n-gram) of n = 1 .. most; grams of equal numbers have equal codes."""
    row, left = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size), size) - np.arange(len(code))
    out, gram = [], code
    for n in range(1, most + 1):
        if n > 1:
            after = np.concatenate([code[n - 1 :], np.zeros(n - 1, np.int64)])[: len(code)]
            gram = gram.astype(np.int64) * (int(code.max(initial=0)) + 1) + after
        out.append((row, left >= n, gram))
        if n > 1:
            gram = pd.factorize(gram)[0].astype(np.int64)
            out[-1] = (row, left >= n, gram)
    return out


#: 64-bit words of match masks that are held at once.
_MASK_WORDS = 1 << 21


def longest_common(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows of codes (ragged), bit-parallel over the first and over all pairs.

    A word holds 64 places of the first sequence; a step takes one token of all second sequences at once and adds its matches
    with carries over the words; zero bits count the common tokens.
    """
    out = np.zeros(len(n_a), np.int64)
    at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    words = -(-n_a // 64)
    order = np.lexsort((-n_b, words))
    order = order[(n_a[order] > 0) & (n_b[order] > 0)]
    start = 0
    while start < len(order):
        width = int(words[order[start]])
        same = int(np.searchsorted(words[order], width, "right"))
        need = np.cumsum(n_a[order[start:same]] * width)
        stop = start + max(1, int(np.searchsorted(need, _MASK_WORDS, "right")))
        own = order[start:stop]
        start = stop
        pick = lambda at, n: np.repeat(at[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(n[own].sum())
        row_a, row_b = (np.repeat(np.arange(len(own)), n[own]) for n in (n_a, n_b))
        key_a, key_b = row_a << 32 | a[pick(at_a, n_a)], row_b << 32 | b[pick(at_b, n_b)]
        known, index = np.unique(key_a, return_inverse=True)
        place = np.arange(len(key_a)) - np.repeat(np.cumsum(n_a[own]) - n_a[own], n_a[own])
        masks = np.zeros((len(known) + 1, width), np.uint64)  # the last: no match
        np.bitwise_or.at(masks, (index, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        hit = np.minimum(np.searchsorted(known, key_b), len(known) - 1)
        hit = np.where(known[hit] == key_b, hit, len(known))
        first = np.cumsum(n_b[own]) - n_b[own]
        state = np.full((len(own), width), np.uint64(0xFFFFFFFFFFFFFFFF))
        alive = np.searchsorted(-n_b[own], -np.arange(int(n_b[own].max())), "left")  # rows with more tokens than j, longest first
        for j, n in enumerate(alive.tolist()):
            match = masks[hit[first[:n] + j]]
            carry = np.zeros(n, np.uint64)
            for w in range(width):
                old = state[:n, w]
                add = old & match[:, w]
                total = old + add
                over = total < old
                after = total + carry
                over |= after < total
                state[:n, w] = after | (old & ~match[:, w])
                carry = over.astype(np.uint64)
        left = n_a[own][:, None] - 64 * np.arange(width)
        inside = np.where(left >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.clip(left, 0, 63).astype(np.uint64)) - np.uint64(1))
        out[own] = np.bitwise_count(~state & inside).sum(1)
    return out


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("bleu4", "rouge1", "rouge2", "rougel")]))
def text_overlap(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """BLEU-4 with add-one smoothing beyond unigrams and ROUGE F, x 100, over white-space tokens; zeros if either has none."""
    (one, n_a), (two, n_b) = _tokens(pred), _tokens(gold)
    codes = pd.factorize(pa.concat_arrays([one, two]).to_pandas())[0].astype(np.int64)
    code_a, code_b = codes[: len(one)], codes[len(one) :]
    both = _grams(codes, np.concatenate([n_a, n_b]), 4)
    n, split = len(n_a), len(one)
    hits = []
    for row, fit, gram in both:
        packed = (row % n if n else row) << 32 | gram
        hits.append(_shared(packed[:split][fit[:split]], packed[split:][fit[split:]], n))
    full = (n_a > 0) & (n_b > 0)
    size = lambda x, k: np.maximum(x - k + 1, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = sum(np.log((hits[k - 1] + (k > 1)) / (size(n_a, k) + (k > 1))) for k in range(1, 5))
        bleu = 100 * np.exp(np.minimum(0.0, 1 - n_b / n_a) + logs / 4)
        f = lambda hit, p, r: np.where((p > 0) & (r > 0), 200 * hit / (p + r), 0.0)
        common = longest_common(code_a, n_a, code_b, n_b)
        found = {"bleu4": bleu, "rouge1": f(hits[0], n_a, n_b), "rouge2": f(hits[1], size(n_a, 2), size(n_b, 2)), "rougel": f(common, n_a, n_b)}
    return pd.DataFrame({k: np.round(np.where(full, np.nan_to_num(v), 0.0), 4) for k, v in found.items()})
