"""The registered queries of problems 3, 7, 8 and 9, with production parameters, over whole tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import lookalike, mixing, packing, runs
from tracewright.llm.tokens import with_tokens
from tracewright.session import cut, load

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse_runs(load(spark, sf_dir, "prov_events"), load(spark, sf_dir, "entities"), min_run=2)
    return found.select("srcid", "first_seq", "n_events")


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapsed_log(load(spark, sf_dir, "prov_events"), load(spark, sf_dir, "entities"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), load(spark, sf_dir, "pack_sizes"))


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing: every token once, no text divided that fits, no container over its capacity."""
    sizes = cut(with_tokens(load(spark, sf_dir, "documents").select("doc_id", "text"), "text"), "sizes")
    return packing.packing_audit(packing.pack_sizes(sizes, load(spark, sf_dir, "pack_sizes")), sizes)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p7_packed(spark, sf_dir))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[1]


def p8_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mixture: repeats up to the cap, each block once a pass, each slot once, shares as targeted."""
    return mixing.mixture_audit(*mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets")))


def p8_corpus_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), of_corpus=1.0)[0]


def p8_corpus_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), of_corpus=1.0)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_alikes(load(spark, sf_dir, "documents"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_classes(load(spark, sf_dir, "documents"))


def p9_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.normalize_text(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "look")


def queries() -> dict[str, Query]:
    return {
        "p3_found": p3_found,
        "p3_collapsed": p3_collapsed,
        "p7_packed": p7_packed,
        "p7_report": p7_report,
        "p7_audit": p7_audit,
        "p8_mixture": p8_mixture,
        "p8_shares": p8_shares,
        "p8_audit": p8_audit,
        "p8_corpus_mixture": p8_corpus_mixture,
        "p8_corpus_shares": p8_corpus_shares,
        "p9_found": p9_found,
        "p9_classes": p9_classes,
        "p9_normalized": p9_normalized,
    }


_RUNS = r"""
WITH rows AS (
  SELECT srcid, etype, dstid, ts, min(seq) AS seq FROM prov_events
  WHERE srcid IS NOT NULL AND etype IS NOT NULL AND dstid IS NOT NULL AND seq IS NOT NULL AND ts > 0
  GROUP BY srcid, etype, dstid, ts),
looks AS (
  SELECT entity_id, uuid, CASE
    WHEN attr IN ('', 'null', 'none', '<unknown>') THEN NULL
    WHEN cls = 'file' THEN 'f' || regexp_replace(attr, '[0-9]+', chr(1), 'g')
    WHEN cls = 'socket' AND len(string_split(attr, ',')) = 4
      THEN 's' || split_part(attr, ',', 1) || chr(1) || split_part(attr, ',', 3) || chr(1) || split_part(attr, ',', 4) END AS look
  FROM entities),
o AS (
  SELECT r.*, uuid, look, lag(etype) OVER w AS e0, lag(ts) OVER w AS t0, lag(dstid) OVER w AS d0, lag(uuid) OVER w AS u0, lag(look) OVER w AS l0
  FROM rows r LEFT JOIN looks ON entity_id = dstid WINDOW w AS (PARTITION BY srcid ORDER BY ts, seq)),
n AS (
  SELECT *, sum(CASE WHEN e0 = etype AND ts - t0 <= 60000000000
      AND (d0 = dstid OR coalesce(u0 = uuid, false) OR coalesce(l0 = look, false)) THEN 0 ELSE 1 END)
    OVER (PARTITION BY srcid ORDER BY ts, seq) AS run FROM o)
"""

P3_FOUND = (
    _RUNS + "SELECT srcid, arg_min(seq, (ts, seq)) AS first_seq, count(*) AS n_events FROM n GROUP BY srcid, run HAVING count(*) >= 2"
)
P3_COLLAPSED = (
    _RUNS
    + """
SELECT srcid, arg_min(etype, (ts, seq)) AS etype, arg_min(dstid, (ts, seq)) AS dstid, arg_min(seq, (ts, seq)) AS first_seq,
  min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events, max(ts) - min(ts) AS duration_ns
FROM n GROUP BY srcid, run
UNION ALL
SELECT srcid, etype, dstid, min(seq), ts, ts, 1, 0 FROM prov_events
WHERE ts > 0 AND (srcid IS NULL OR etype IS NULL OR dstid IS NULL OR seq IS NULL) GROUP BY srcid, etype, dstid, ts
UNION ALL
SELECT srcid, etype, dstid, seq, ts, ts, 1, NULL FROM prov_events WHERE ts IS NULL OR ts <= 0
"""
)


#: Fixed values, by range: characters that leave no mark (format and control characters, fillers, selectors).
_GONE = (
    r"[\x{0}-\x{8}\x{E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}-\x{1160}\x{17B4}-\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}"
    r"\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{1BCA0}-\x{1BCA3}"
    r"\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}]"
)
#: Spaces of any kind but the plain one.
_SPACES = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
#: What letters of other scripts or styles look like, the letter first.
_LETTERS = """
A АΑ; B ВΒ; C СϹ; E ЕΕ; F Ϝ; G Ԍ; H НΗ; I ІΙӀ; J ЈͿ; K КΚ; M МΜϺ; N Ν; O ОΟ; P РΡ; Q Ԛ; S Ѕ; T ТΤ; V Ѵ; W Ԝ; X ХΧ; Y ҮΥ; Z Ζ
a а; c сϲᴄ; d ԁ; e е; g ɡ; h һ; i і; j јϳ; l ӏ; o оοᴏ; p рρ; q ԛ; s ѕꜱ; v ѵνᴠ; w ԝᴡ; x х; y уү; z ᴢ
Æ Ӕ; æ ӕ; Ə Ә; ə ә; Ɛ Ԑ; ɛ ԑε; Ʒ Ӡ; ʒ ӡ; Ɔ Ͻ; ɔ ͻ; Ɵ ӨΘѲϴ; ɵ өѳ; ĸ кκᴋ; ı ιɩ; Þ Ϸ; þ ϸ
Г Γ; П Π; Ф Φ; Σ Ʃ; Ψ Ѱ; ψ ѱ; ʙ в; ʜ н; ᴍ м; ᴛ т; ᴙ я; - ‐‑﹣; μ µ
"""
#: The half-width katakana and their marks, from U+FF61 on.
_KATAKANA = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン\u3099\u309a"


def _look() -> str:
    """The one form of column text, in SQL: what leaves no mark goes, then characters are mapped one by one, and composed.

    Written from the rules of the problem, apart from the operator. An accented letter is mapped
    by its base; where its form is more than one character SQL's mapping can't hold it.
    """
    shape = {c: letter for line in _LETTERS.replace(";", "\n").split("\n") if line.strip() for letter, others in [line.split()] for c in others}
    width = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict(zip(map(chr, range(0xFF61, 0xFFA0)), _KATAKANA))
    width |= dict(zip("｟｠￠￡￢￣￤￥￦￨￩￪￫￬￭￮", "⦅⦆¢£¬¯¦¥₩│←↑→↓■○"))
    for first, last, to in ((0xFFA1, 0xFFBE, 0x3131), (0xFFC2, 0xFFC7, 0x314F), (0xFFCA, 0xFFCF, 0x3155), (0xFFD2, 0xFFD7, 0x315B), (0xFFDA, 0xFFDC, 0x3161)):
        width |= {chr(c): chr(to + c - first) for c in range(first, last + 1)}
    pairs = width | shape
    for c in map(chr, range(0xC0, 0x2000)):  # accented letters, in the blocks of the three scripts
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0] in shape:
            form = unicodedata.normalize("NFC", shape[parts[0]] + parts[1:])
            if len(form) == 1:
                pairs[c] = form
    old, new = ("".join(x).replace("'", "''") for x in zip(*pairs.items()))
    plain = f"regexp_replace(regexp_replace(text, '{_GONE}', '', 'g'), '{_SPACES}', ' ', 'g')"
    return f"nfc_normalize(translate(nfc_normalize({plain}), '{old}', '{new}'))"


def oracle_sql() -> dict[str, str]:
    look = _look()
    return {
        "p3_found": P3_FOUND,
        "p3_collapsed": P3_COLLAPSED,
        "p9_found": f"""
WITH looks AS (SELECT doc_id, text, {look} AS look FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM looks a JOIN looks b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text""",
        "p9_classes": f"""
WITH looks AS (SELECT doc_id, text, {look} AS look FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
classes AS (SELECT look, min(doc_id) AS class_id, count(*) AS n_members, count(DISTINCT text) AS n_texts FROM looks GROUP BY look)
SELECT doc_id, class_id, n_members, n_texts FROM looks JOIN classes USING (look) WHERE n_texts > 1""",
        "p7_audit": """
SELECT profile, capacity_tokens, count(DISTINCT doc_id) AS n_texts, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_divided, CAST(0 AS BIGINT) AS n_apart,
  CAST(0 AS BIGINT) AS n_overfull
FROM documents, (SELECT DISTINCT profile, capacity_tokens FROM pack_sizes WHERE profile IS NOT NULL AND capacity_tokens > 0) GROUP BY profile, capacity_tokens""",
        "p8_audit": """
SELECT source, target_share, max_repeats, CAST(0 AS BIGINT) AS n_beyond_cap, CAST(0 AS BIGINT) AS n_twice_a_pass, CAST(0 AS BIGINT) AS n_slots_twice, true AS as_targeted
FROM mix_targets""",
        "p9_normalized": f"SELECT doc_id, {look} AS look FROM documents",
    }
