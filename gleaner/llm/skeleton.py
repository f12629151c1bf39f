"""One consistent form for text that looks the same (problem 2).

Method: confusables skeleton. A text is decomposed canonically, every character is replaced by the
prototype of its look-alike class, and the result is decomposed again. Texts with equal skeletons
look the same. ``consistent`` composes the skeleton again, which is the form to read and compare.

The look-alike classes come from rules over the Unicode character database, from the public table of
confusable characters that Spark itself brings (read on the driver for letters that look like a Latin
one, and handed to the tasks), and from the short lists below, which go first. Width variants, no-break forms, font variants, ligatures, radicals and compatibility
ideographs follow from the decomposition mappings; blanks become one blank; characters that print
nothing vanish. Letter case, voicing marks, small kana and circled or raised digits stay different.

Null gives null, an empty text or one of invisible characters only gives an empty text. The text is
taken whole, whatever its length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import ship

# Characters drawn alike in different scripts or blocks, prototype first. Letters keep
# their case; kana are the prototypes of the kanji drawn like them.
LOOK_ALIKE_LETTERS = (
    "AΑАᎪꓮ", "BΒВᏴꓐ", "CСϹᏟꓚⅭ", "DᎠꓓⅮ", "EΕЕᎬꓰ", "FϜꓝ", "GԌᏀꓖ", "HΗНᎻꓧ", "IΙІӀᏆꓲⅠ", "JЈͿᎫꓙ", "KΚКᏦꓗ", "LᏞꓡⅬ",
    "MΜМϺᎷꓟⅯ", "NΝꓠ", "OΟОՕꓳ", "PΡРᏢꓑ", "QԚ", "RᎡᏒꓣ", "SЅՏᏚꓢ", "TΤТᎢꓔ", "UՍꓴ", "VѴᏙꓦⅤ", "WԜᎳꓪ", "XΧХꓫⅩ",
    "YΥҮꓬ", "ZΖᏃꓜ", "aаɑα", "cсϲⅽ", "dԁⅾ", "eеҽ", "gɡց", "hһհ", "iіιⅰ", "jјϳ", "lӏⅼ", "mⅿ", "nո", "oоοօσ", "pрρ",
    "qԛզ", "sѕ", "uսυ", "vѵνⅴ", "wԝѡ", "xхⅹ", "yуγү",
)
LOOK_ALIKE_KANA = (
    "ー一―—─㇐ㅡᅳ", "ヘへ", "エ工", "カ力", "タ夕", "ト卜", "ニ二", "ハ八", "ロ口囗", "ミ彡", "ヒ匕", "ノ丿",
)
LOOK_ALIKE_SIGNS = (
    "-‐‑‒–−⁃﹣˗➖", "~〜∼∿⁓˜～", "・·‧•∙⋅᛫ꞏ･", "。｡",
)
# Where letters of other scripts are looked up in the public table.
LETTER_RANGES = ((0x80, 0x3100), (0xA000, 0xB000), (0x10000, 0x10600))
SPACING_MARKS = {0x309B: "゙", 0x309C: "゚"}
BLANK_LETTERS = (0x2800, 0x3164, 0xFFA0)
INVISIBLE_MARKS = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5)
VISIBLE_FORMATS = frozenset([*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD])
MERGED_MAPPINGS = ("<wide>", "<narrow>", "<noBreak>", "<font>")


def _prototype(code: int) -> str | None:
    """What replaces the character, or None where it stands for itself."""
    char = chr(code)
    kind = unicodedata.category(char)
    if code in SPACING_MARKS:
        return SPACING_MARKS[code]
    if code in INVISIBLE_MARKS or 0xFE00 <= code <= 0xFE0F or 0x180B <= code <= 0x180F or 0xE0000 <= code <= 0xE0FFF:
        return ""
    if code in BLANK_LETTERS or char.isspace() or kind in ("Zs", "Zl", "Zp"):
        return " "
    if kind == "Cc" or (kind == "Cf" and code not in VISIBLE_FORMATS):
        return ""
    tag, _, mapped = unicodedata.decomposition(char).partition(" ")
    radical = 0x2E80 <= code <= 0x2FDF
    ligature = tag == "<compat>" and (0xFB00 <= code <= 0xFB06 or 0x01C4 <= code <= 0x01CC or 0x2160 <= code <= 0x217F)
    dotted = tag == "<compat>" and 0x2024 <= code <= 0x2026
    if tag in MERGED_MAPPINGS or (tag == "<compat>" and (radical or ligature or dotted)):
        return "".join(chr(int(x, 16)) for x in mapped.split())
    return None


def public_letters(spark: SparkSession) -> str:
    """Letters of other scripts and blocks that the public table draws like one Latin letter: pairs of the letter and that one.

    The table takes I and l as one; here a capital letter is an I. Where the table is missing, gives nothing or doesn't answer
    letter by letter there is an error: look-alikes would be lost without a sign.
    """
    if spark not in _PUBLIC:
        letters = [chr(c) for low, high in LETTER_RANGES for c in range(low, high) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lo")]
        try:
            checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        except (AttributeError, TypeError) as error:
            raise RuntimeError("look-alike letters need the public table in Spark's ICU (com.ibm.icu.text.SpoofChecker), which this session lacks") from error
        alike = checker.getSkeleton(0, "\n".join(letters)).split("\n")
        if len(alike) != len(letters):
            raise RuntimeError(f"the public table gives {len(alike)} look-alikes for {len(letters)} letters")
        drawn = ((c, "I" if x == "l" and unicodedata.category(c) == "Lu" else x) for c, x in zip(letters, alike))
        public = "".join(c + x for c, x in drawn if len(x) == 1 and x.isascii() and x.isalpha())
        if not public:
            raise RuntimeError("the public table draws no letter like a Latin one")
        _PUBLIC[spark] = public
    return _PUBLIC[spark]


def _build(public: str = "") -> dict[int, str]:
    steps: dict[int, str] = {ord(c): x for c, x in zip(public[::2], public[1::2])}
    for group in (*LOOK_ALIKE_LETTERS, *LOOK_ALIKE_KANA, *LOOK_ALIKE_SIGNS):
        for char in group:
            steps.pop(ord(char), None)
        for char in group[1:]:
            steps[ord(char)] = group[0]
    # Beyond the basic plane only mathematical letters, tags and selectors have a rule; NFD does the ideographs.
    for code in (*range(0xD800), *range(0xE000, 0x10000), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE1000)):
        if code in steps:
            continue
        to = _prototype(code)
        if to is not None:
            steps[code] = to

    def final(text: str, depth: int = 0) -> str:
        done = "".join(steps.get(ord(c), c) for c in unicodedata.normalize("NFD", text))
        return done if done == text or depth == 6 else final(done, depth + 1)

    return {code: end for code, to in steps.items() if (end := final(to)) != chr(code)}


_PUBLIC: dict[SparkSession, str] = {}
_TABLES: dict[str, dict[int, str]] = {}


def look_alikes(public: str = "") -> dict[int, str]:
    """The look-alike table, built once in each Python process."""
    if public not in _TABLES:
        _TABLES[public] = _build(public)
    return _TABLES[public]


def skeleton(text: str | None, public: str = "") -> str | None:
    """Decompose, replace each character by its prototype, decompose again.

    ``public`` is what ``public_letters`` gives; without it letters come from the short lists alone.
    """
    if text is None:
        return None
    if text.isascii() and text.isprintable():
        return text
    decompose = unicodedata.normalize
    return decompose("NFD", decompose("NFD", text).translate(look_alikes(public)))


def consistent(text: str | None, public: str = "") -> str | None:
    """The skeleton, composed again."""
    return None if text is None else unicodedata.normalize("NFC", skeleton(text, public))


# Texts of a batch are joined by a noncharacter and handled in one pass; U+FFFF has no mapping.
_JOINT = "￿"


def skeletons(texts: list[str | None], compose: bool = False, public: str = "") -> list[str | None]:
    """``skeleton`` (or ``consistent``) of many texts, several times faster than one by one."""
    held = [i for i, x in enumerate(texts) if x is not None]
    if any(_JOINT in texts[i] for i in held):
        one = consistent if compose else skeleton
        return [one(x, public) for x in texts]
    whole = unicodedata.normalize("NFD", _JOINT.join(texts[i] for i in held)).translate(look_alikes(public))
    out: list[str | None] = [None] * len(texts)
    if held:
        for i, x in zip(held, unicodedata.normalize("NFC" if compose else "NFD", whole).split(_JOINT)):
            out[i] = x
    return out


def _mapper(columns: list[str], outputs: list[str], compose: bool, public: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays, names = list(batch.columns), list(batch.schema.names)
            for column, output in zip(columns, outputs):
                done = skeletons(batch.column(names.index(column)).to_pylist(), compose, public)
                arrays.append(pa.array(done, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [*names, *outputs])

    return run


def with_skeleton(df: DataFrame, columns: list[str], suffix: str = "_skeleton", compose: bool = False) -> DataFrame:
    """``df`` with the skeleton of each text column beside it, in one pass without a shuffle.

    A column that has the name of an output is replaced by it. Other columns, of any type, pass unchanged.
    """
    ship(df.sparkSession)
    outputs = [c + suffix for c in columns]
    df = df.drop(*outputs)
    schema = T.StructType([*df.schema.fields, *(T.StructField(o, T.StringType()) for o in outputs)])
    return df.mapInArrow(_mapper(columns, outputs, compose, public_letters(df.sparkSession)), schema)


def same_look(a: str, b: str) -> Column:
    """Different strings with equal skeletons, over the columns ``with_skeleton`` adds."""
    return (F.col(a) != F.col(b)) & (F.col(f"{a}_skeleton") == F.col(f"{b}_skeleton"))


def look_alike_pairs(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Keys of the rows whose two texts differ as strings and look the same.

    Rows with a null text give nothing; rows equal as strings never reach Python. Repeated keys come
    out once.
    """
    rows = df.select(F.col(key).alias("k"), F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b")
    return with_skeleton(rows, ["a", "b"]).filter(same_look("a", "b")).select(F.col("k").alias(key)).distinct()


def look_alike_groups(df: DataFrame, column: str) -> DataFrame:
    """Groups of different originals with one skeleton: ``skeleton_id``, ``text``, ``n_rows``, ``n_forms``.

    Copies are counted before Python sees them, so a text that holds a third of all rows is one row
    by then. Null texts are left out. One row per original text.
    """
    texts = df.select(F.col(column).alias("text")).filter("text is not null").groupBy("text").agg(F.count("*").alias("n_rows"))
    marked = with_skeleton(texts, ["text"]).withColumn("skeleton_id", F.sha2("text_skeleton", 256))
    forms = marked.groupBy("skeleton_id").agg(F.count("*").alias("n_forms")).filter("n_forms > 1")
    return marked.join(forms, "skeleton_id").select("skeleton_id", "text", "n_rows", "n_forms")
