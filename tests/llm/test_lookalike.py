import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.helpers import order, rows
from tracewright.llm.lookalike import HYPHENS, MARKED_FORMAT, SAME_SHAPE, SEEN_CONTROLS, UNMARKED, Normalizer, look_alikes, look_classes, mappings, normalize_text

N = Normalizer(*mappings())
SHAPE = {c: g[0] for g in SAME_SHAPE for c in g[1:]}


def unseen(c):
    o, cat = ord(c), unicodedata.category(c)
    if cat == "Cf":
        return not any(a <= o <= b for a, b in MARKED_FORMAT)
    return (cat == "Cc" and c not in SEEN_CONTROLS) or any(a <= o <= b for a, b in UNMARKED)


def brute(text):
    """Character by character, with the library's own normal forms."""
    text = "".join(c for c in text if not unseen(c))
    while True:
        wide = ""
        for c in unicodedata.normalize("NFD", text):
            kind, _, rest = unicodedata.decomposition(c).partition(" ")
            wide += "".join(chr(int(x, 16)) for x in rest.split()) if kind in ("<wide>", "<narrow>") else c
        if wide == text:
            break
        text = wide
    out = ""
    for c in text:
        if unseen(c):
            continue
        out += " " if unicodedata.category(c) == "Zs" else "-" if c in HYPHENS else "μ" if c == "µ" else SHAPE.get(c, c)
    return unicodedata.normalize("NFC", out)


ODD = "aeoсеіoAАΑKКΚK é ẹ́́  　 ​‍﻿­‑‐-ｆ１（ıil1O0²₂\n\r\t\x00\x0b\u0085ﾊﾞハバ가가각ᆨΐϊїйཱི̈́👩‍💻\U000e0041᠎µμΩΩ"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=ODD, max_size=25), st.text(max_size=12)), max_size=6))
def test_is_brute_force(texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    got = N.apply(list(texts))
    assert got == [brute(t) for t in texts]
    assert N.apply(got) == got  # a form is its own form


def test_every_code_point():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert N.apply(every) == [brute(c) for c in every]


@pytest.mark.parametrize(
    "a,b",
    [
        ("ｆｕｌｌ １２", "full 12"), ("café", "café"), ("a​b­", "ab"), ("a b　c", "a b c"), ("раy", "pay"), ("Ηello", "Hello"),
        ("re‑use", "re-use"), ("K", "K"), ("q̣̇", "q̣̇"), ("ﾊﾞ", "バ"), ("가", "가"), ("﻿x", "x"), ("ＡΑ", "AА"),
    ],
)
def test_look_the_same(a, b):
    x, y = N.apply([a, b])
    assert x == y and a != b


@pytest.mark.parametrize(
    "a,b", [("0", "O"), ("1", "l"), ("a", "A"), ("é", "e"), ("ı", "i"), ("x²", "x2"), ("H₂O", "H2O"), ("a\nb", "a b"), ("a  b", "a b"), ("a\tb", "a b"), ("–", "-"), ("’", "'"), ("ß", "ss")]
)
def test_look_different(a, b):
    x, y = N.apply([a, b])
    assert x != y


SCHEMA = "doc_id long, text string, look string, own string"


def test_pairs_are_brute_force(spark):
    texts = ["pay", "раy", "pay", "ｐay", "PAY", None, None, "", "​", "", "x y", "x y", "x  y", "same", "same", "long " * 20000, "long " + "long " * 19999]
    docs = [(i * 3 + 1, t, "?", "?") for i, t in enumerate(texts)]
    want = [(a, b) for a, s, *_ in docs for b, t, *_ in docs if a < b and s is not None and t is not None and s != t and brute(s) == brute(t)]
    got = look_alikes(spark.createDataFrame(docs, SCHEMA).repartition(3))
    assert rows(got) == order(want) and len(want) == 9


def test_normalize_text_keeps_rows(spark):
    docs = [(1, "ａ", "old", "k"), (2, None, None, "k"), (2, None, None, "k")]
    got = normalize_text(spark.createDataFrame(docs, SCHEMA))
    assert got.columns == ["doc_id", "text", "own", "look"]
    assert rows(got, "doc_id", "look") == order([(1, "a"), (2, None), (2, None)])


def test_empty(spark):
    assert look_alikes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_letters_of_one_shape_in_either_case():
    normalizer = Normalizer(*mappings())
    groups = "ƐԐ ɛԑε YҮ yү ƷӠ ʒӡ ƟӨΘѲ ɵөѳ ΨѰ ψѱ ĸкκ ƆϽ ɔͻ ΣƩ ÞϷ þϸ ʙв ʜн ᴍм ᴛт ᴙя cᴄ oᴏ sꜱ vᴠ wᴡ zᴢ".split()
    assert [len(set(normalizer.apply(list(g)))) for g in groups] == [1] * len(groups)
    assert len(set(normalizer.apply([g[0] for g in groups]))) == len(groups)


def test_no_letter_is_in_two_groups():
    letters = "".join(SAME_SHAPE)
    assert len(set(letters)) == len(letters)


def test_sql_of_every_code_point():
    """The SQL is written apart from the operator; they agree on every character whose form is one character at most."""
    import duckdb

    from tracewright.llm.queries import _look

    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    forms = Normalizer(*mappings()).apply([chr(c) for c in points])
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT i AS doc_id, chr(CAST(i AS INTEGER)) AS text FROM range(1, 1114112) t(i) WHERE i NOT BETWEEN 55296 AND 57343")
    theirs = dict(con.execute(f"SELECT doc_id, {_look()} FROM documents").fetchall())
    assert [(hex(c), f, theirs[c]) for c, f in zip(points, forms) if theirs[c] != f and len(f) < 2] == []


def test_classes(spark):
    texts = ["pay", "р\u0430y", "pay", "PAY", None, "", "\u200b", "same", "same", "x y", "x\u00a0y"]
    docs = spark.createDataFrame([(i + 5, t, "?", "?") for i, t in enumerate(texts)], SCHEMA)
    got = rows(look_classes(docs.repartition(3)), "doc_id", "class_id", "n_members", "n_texts")
    assert got == order([(5, 5, 3, 2), (6, 5, 3, 2), (7, 5, 3, 2), (10, 10, 2, 2), (11, 10, 2, 2), (14, 14, 2, 2), (15, 14, 2, 2)])
    assert look_classes(docs.where("false")).count() == 0
