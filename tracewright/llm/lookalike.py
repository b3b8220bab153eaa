"""Texts that look the same brought to one form.

Inside each Arrow batch the texts are exploded to one column of positioned code points beside the
column of their documents. Two mappings, built by rule from the Unicode character database (plus a short
list of letters of the same shape) and broadcast once, are joined to it by code point: the
decomposition, which may give several code points or none, and the look-alike. Combining marks
are then ordered by class behind their base, and the texts rebuilt and recomposed. A batch is
self-contained, so no code point ever crosses the network.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import cut

#: Letters of the same shape, each group headed by the letter it is written as.
SAME_SHAPE = (
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "FϜ", "GԌ", "HНΗ", "IІΙӀ", "JЈͿ", "KКΚ", "MМΜϺ", "NΝ", "OОΟ", "PРΡ", "QԚ", "SЅ", "TТΤ", "VѴ", "WԜ", "XХΧ", "YҮΥ", "ZΖ",
    "aа", "cсϲᴄ", "dԁ", "eе", "gɡ", "hһ", "iі", "jјϳ", "lӏ", "oоοᴏ", "pрρ", "qԛ", "sѕꜱ", "vѵνᴠ", "wԝᴡ", "xх", "yуү", "zᴢ",
    "ÆӔ", "æӕ", "ƏӘ", "əә", "ƐԐ", "ГΓ", "ПΠ", "ФΦ", "ıιɩ",
    "ɛԑε", "ƷӠ", "ʒӡ", "ƟӨΘѲϴ", "ɵөѳ", "ΨѰ", "ψѱ", "ĸкκᴋ", "ƆϽ", "ɔͻ", "ΣƩ", "ÞϷ", "þϸ", "ʙв", "ʜн", "ᴍм", "ᴛт", "ᴙя",
)
#: The hyphens drawn like the ASCII one (its wide form decomposes to it).
HYPHENS = "‐‑﹣"
#: Format characters that do have a mark, by range.
MARKED_FORMAT = ((0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F))
#: Characters without a mark outside the format category, by range.
UNMARKED = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))
#: Control characters that break lines or move on, and so are seen.
SEEN_CONTROLS = "\t\n\x0b\x0c\r\x85"

_PLAIN = re.compile(r"[\t-\r -~]*", re.ASCII)


def _within(cp: int, ranges) -> bool:
    return any(a <= cp <= b for a, b in ranges)


def _invisible(ch: str) -> bool:
    cat, cp = unicodedata.category(ch), ord(ch)
    if cat == "Cf":
        return not _within(cp, MARKED_FORMAT)
    return (cat == "Cc" and ch not in SEEN_CONTROLS) or _within(cp, UNMARKED)


def _width_form(ch: str) -> str:
    """Canonically decomposed, width forms taken back to the one character."""
    out = []
    for c in unicodedata.normalize("NFD", ch):
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        if kind in ("<wide>", "<narrow>"):
            out += [x for y in rest.split() for x in _width_form(chr(int(y, 16)))]
        else:
            out.append(c)
    return "".join(out)


@lru_cache(maxsize=1)
def mappings() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points that change, how many code points each becomes, those code points, marks, their classes).

    Its size is fixed by Unicode, whatever the corpus.
    """
    shape = {c: group[0] for group in SAME_SHAPE for c in group[1:]} | {h: "-" for h in HYPHENS} | {"µ": "μ"}
    cps, lens, flat, marks, classes = [], [], [], [], []
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch):
            marks.append(cp)
            classes.append(unicodedata.combining(ch))
        if cp < 0x80 and not _invisible(ch):
            continue
        new = "".join(
            "" if _invisible(c) else " " if unicodedata.category(c) == "Zs" else shape.get(c, c) for c in ("" if _invisible(ch) else _width_form(ch))
        )
        if new != ch:
            cps.append(cp)
            lens.append(len(new))
            flat += map(ord, new)
    return tuple(np.array(x, np.int64) for x in (cps, lens, flat, marks, classes))


class Normalizer:
    """The mappings as arrays by code point, and their application to a batch of texts."""

    def __init__(self, cps, lens, flat, marks, classes):
        n = sys.maxunicode + 1
        self.length = np.ones(n, np.int8)
        self.length[cps] = lens
        self.at = np.arange(n, dtype=np.int32)  # where a code point's own new ones begin in self.flat
        self.flat = np.r_[np.arange(n, dtype=np.int32), flat.astype(np.int32)]
        self.at[cps] = n + np.cumsum(lens) - lens
        self.ccc = np.zeros(n, np.uint8)
        self.ccc[marks] = classes

    def batch(self, texts: list[str]) -> list[str]:
        """The texts in their one form."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        many = self.length[points].astype(np.int64)
        origin = np.repeat(np.arange(len(points)), many)
        step = np.arange(len(origin)) - np.repeat(np.cumsum(many) - many, many)
        new, doc = self.flat[self.at[points[origin]] + step], doc[origin]
        if not len(new):
            return [""] * len(texts)
        order_class = self.ccc[new]
        if order_class.any():
            starts = order_class == 0
            starts[1:] |= doc[1:] != doc[:-1]
            starts[0] = True
            base = np.cumsum(starts)
            # a mark that opens a text has no base; 256 places per base keep it in its own text
            new = new[np.argsort(base * 256 + order_class, kind="stable")]
        whole = new.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        ends = np.cumsum(np.bincount(doc, minlength=len(texts))).tolist()
        return [unicodedata.normalize("NFC", whole[a:b]) for a, b in zip([0, *ends], ends)]

    def apply(self, texts: list[str | None], most: int = 2_000_000) -> list[str | None]:
        """Null stays null; plain ASCII texts are their own form; others go in groups of bounded size."""
        out = list(texts)
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if t and not _PLAIN.fullmatch(t):
                group.append(i)
                size += len(t)
                if size >= most:
                    self._fill(out, group)
                    group, size = [], 0
        self._fill(out, group)
        return out

    def _fill(self, out: list, group: list[int]) -> None:
        if group:
            for i, t in zip(group, self.batch([out[i] for i in group])):
                out[i] = t


_kept: list[Normalizer] = []  # one in each worker


def _normalizer(tables) -> Normalizer:
    if not _kept:
        _kept.append(Normalizer(*tables))
    return _kept[0]


def normalize_text(rows: DataFrame, text: str = "text", to: str = "look") -> DataFrame:
    """``rows`` with the column ``to``: the text in the one form under which texts that look the same are equal.

    Brought together: width forms, composed and combining accents, characters without a visible
    mark, spaces of any kind, Latin, Cyrillic and Greek letters of one shape, hyphens of one
    shape. Kept apart: different ASCII characters, case, accents and dots, raised and lowered
    digits, line breaks, the number of spaces. Null stays null, an empty text empty; whole texts
    of any length are taken. An existing column ``to`` is replaced.
    """
    sc = rows.sparkSession.sparkContext
    tables = sc.broadcast(mappings())
    rows = rows.drop(to)
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalizer = _normalizer(tables.value)
        for batch in batches:
            new = pa.array(normalizer.apply(batch.column(at).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, to])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{to}` string")


def _keys(documents: DataFrame) -> DataFrame:
    """(doc_id, look, own): digests of a text's one form and of the text, of documents whose form several different texts share."""
    looks = normalize_text(documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text"))
    keys = cut(looks.select("doc_id", F.sha2("look", 256).alias("look"), F.sha2("text", 256).alias("own")), "looks")
    mixed = keys.groupBy("look").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo < hi").select("look")
    return cut(keys.join(mixed, "look", "left_semi"), "members")


def look_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_members, n_texts): the class of each document that looks like one of another text.

    class_id is the smallest doc_id of the class, n_members its documents and n_texts its different texts: all pairs in as
    many rows as there are documents. A class of most documents is counted map side.
    """
    members = _keys(documents)
    texts = members.groupBy("look", "own").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"))
    classes = texts.groupBy("look").agg(F.min("low").alias("class_id"), F.sum("n").alias("n_members"), F.count(F.lit(1)).alias("n_texts"))
    return members.join(classes, "look").select("doc_id", "class_id", "n_members", "n_texts")


def look_alikes(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents whose texts are not equal but look the same.

    Null texts look like nothing; empty ones look like texts without any visible character.
    Classes of one single text, however many its copies, are dropped before any join, so exact
    copies alone never meet.
    """
    members = _keys(documents)
    a, b = members.alias("a"), members.alias("b")
    on = (F.col("a.look") == F.col("b.look")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.own") != F.col("b.own"))
    return a.join(b, on).select(F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b"))
