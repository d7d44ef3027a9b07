"""Problem 10: sentence units of texts in many languages, as SQL expressions.

Marks that end nothing (in numbers, addresses, initials, abbreviations, item numbers, brackets and quotes) are masked one
character for one character with private-use placeholders, so that positions stay; what then ends a sentence in its
script is marked, the text is cut there and at line ends, and every piece is restored by its position from the text as it
stands. All of it happens inside the row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import spread

#: Abbreviations before a name, number or noun, and month names after an ordinal.
ABBREVIATIONS = (
    "Dr|Mr|Mrs|Ms|Messrs|Prof|Rev|Inc|Ltd|Co|Corp|Jr|Sr|al|Hon|Gen|Capt|Sgt|Lt|Col|St|Mt|N[oо]|Nos|[Vv]ol|[Vv]ols|vs|Figs?|[Ff]іg|[Ee]ds?|[Cc]h|[Ss]ec|[Pp]p|cf|viz|approx|"
    "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec|Mon|Tue|Wed|Thu|Fri|Sat|Sun|"
    "Nr|Hr|Fr|ca|bzw|evtl|ggf|inkl|vgl|Abb|Tab|Bd|Abs|Art|Kap|Str|Tel|Dipl|Ing|Mme|Mlle|MM|éd|chap|fig|env|art|"
    "[Пп]роф|[Дд]оц|[Аа]кад|[Ии]м|[Уу]л|[Сс]тр|[Рр]ис|[Тт]абл|тел|гл|ст|пр|обл|[Сс]м|[Нн]апр|тыс|млн|млрд|डॉ|प्रो|श्री|सुश्री|पं|सं|क्र"
)
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
BLANK = r"[ \t\x0B\f\r\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
HIDDEN = r"[\u00AD\u200B-\u200D\u2060\uFEFF]"
DOT, OPEN, CLOSE, BRACKET, UNBRACKET, CUT = "\uE001", "\uE010", "\uE011", "\uE012", "\uE013", "\uE01F"
END = "[。！？｡!?.…।॥]"
CLOSERS = f"(?:{BLANK}?{CLOSE}|[{UNBRACKET}’'\"”」』»])*"
EAST = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}、-〟！-～"

#: (pattern, replacement), in this order; every replacement keeps the number of characters.
MASKS = [
    ("[\uE000-\uE01F]", "\uFFFC"),
    (r"(?<=[A-Za-z0-9_/\-])[.?!](?=[A-Za-z0-9/_=&#\-])", DOT),
    (r"(?<=[0-9０-９])[.．](?=[0-9０-９])", DOT),
    (rf"(?<![\p{{L}}\p{{M}}])({ABBREVIATIONS})\.", f"$1{DOT}"),
    (rf"(?<![\p{{L}}\p{{M}}.{DOT}])(?!г\.{BLANK}+\p{{Lu}})([\p{{Lu}}\p{{Ll}}])\.(?={HIDDEN}*{BLANK})", f"$1{DOT}"),
    (rf"(?<=[0-9])\.(?={BLANK}+(?:{MONTHS})\b)", DOT),
    (rf"(?m)^({BLANK}*\p{{IsHan}}{{0,4}}{BLANK}?[0-9０-９]{{1,3}})[.．]", f"$1{DOT}"),
    (rf"„([^„“”\n]*+)“", f"{OPEN}$1{CLOSE}"),
    (rf"“([^“”\n]*+)”", f"{OPEN}$1{CLOSE}"),
    (rf"«([^«»\n]*+)»", f"{OPEN}$1{CLOSE}"),
    (rf"「([^「」\n]*+)」", f"{OPEN}$1{CLOSE}"),
    (rf"『([^『』\n]*+)』", f"{OPEN}$1{CLOSE}"),
    (rf"（([^（）\n]*+)）", f"{BRACKET}$1{UNBRACKET}"),
    (rf"\(([^()\n]*+)\)", f"{BRACKET}$1{UNBRACKET}"),
    (rf"\[([^\[\]\n]*+)\]", f"{BRACKET}$1{UNBRACKET}"),
    (rf"【([^【】\n]*+)】", f"{BRACKET}$1{UNBRACKET}"),
    (rf"《([^《》\n]*+)》", f"{BRACKET}$1{UNBRACKET}"),
]
#: The same on the reversed text: end marks before a closing mark, reached from it without another mark between.
BACK_MASKS = [(rf"((?:{close}|\G(?!\A))[^{END[1:-1]}{open_}{close}\n]*+){END}", f"$1{DOT}") for open_, close in ((OPEN, CLOSE), (BRACKET, UNBRACKET))]
#: A following small letter goes on with the sentence, but not one before a capital (as in product names).
GOES_ON = rf"(?!{HIDDEN}*\p{{Ll}}(?!\p{{Lu}}))"
#: (pattern, replacement): where a cut is added.
CUTS = [
    # a quote that follows a colon or comma and ends with an end mark ends the sentence that carries it
    (rf"([：:,，]{BLANK}*{OPEN}[^{OPEN}{CLOSE}\n]*{DOT}{HIDDEN}*{BLANK}?{CLOSE})(?!{BLANK}*[,，、；;。！？!?.…—–-])(?!{BLANK}*\p{{Ll}}(?!\p{{Lu}}))", f"$1{CUT}"),
    # marks of East Asian and Devanagari text
    (rf"([!?.…]*[。！？｡।॥][。！？｡।॥!?.…]*{CLOSERS})(?![,，、；：])", f"$1{CUT}"),
    # an ellipsis or Western mark before East Asian text
    (rf"((?:…+|(?<=[\p{{L}}\p{{N}}{DOT}{CLOSE}{UNBRACKET}])[.!?]+){CLOSERS})(?=[{EAST}“「『《（【{OPEN}{BRACKET}])(?![，、；：，。！？）])", f"$1{CUT}"),
    (rf"(…{{2,}}{CLOSERS})(?=[0-9])", f"$1{CUT}"),
    # Western marks before a blank and a new beginning
    (rf"([.!?…]+{HIDDEN}*{CLOSERS})(?={HIDDEN}*{BLANK}+{HIDDEN}*[^\s,;:.!?…\-–—]){GOES_ON}(?={HIDDEN}*{BLANK}+{GOES_ON})", f"$1{CUT}"),
    # blanks of Thai text
    (rf"(?<=[ก-๛0-9%)”])({BLANK}+)(?=[ก-๛“])", f"$1{CUT}"),
]


def pieces(text: Column) -> Column:
    """The text cut into pieces; together they have the characters of the text in number and place."""
    for pattern, new in MASKS:
        text = F.regexp_replace(text, pattern, new)
    text = F.reverse(text)
    for pattern, new in BACK_MASKS:
        text = F.regexp_replace(text, pattern, new)
    text = F.reverse(text)
    for pattern, new in CUTS:
        text = F.regexp_replace(text, pattern, new)
    return F.split(text, rf"{CUT}|(?<=\n)")


#: Pieces in blocks of about the root of their number, so that adding up positions costs n^1.5 at most; (size, head, body)
#: of a piece are its characters, those before its sentence, and those of the sentence.
BLOCK = "cast(ceil(sqrt(size(_parts))) as int)"
FIRSTS = """aggregate(sequence(1, cast(ceil(size(_parts) / _block) as int)), array(0L),
    (a, k) -> array_append(a, element_at(a, -1) + aggregate(slice(_parts, (k - 1) * _block + 1, _block), 0L, (s, x) -> s + x.size)))"""
UNITS = """flatten(transform(sequence(1, size(_firsts) - 1), k -> aggregate(slice(_parts, (k - 1) * _block + 1, _block),
    named_struct('at', 0L, 'out', cast(array() as array<struct<start:bigint,body:int>>)),
    (a, x) -> named_struct('at', a.at + x.size, 'out', if(x.body > 0, array_append(a.out, named_struct('start', a.at + x.head, 'body', x.body)), a.out)),
    a -> transform(a.out, u -> named_struct('start_pos', _firsts[k - 1] + u.start, 'end_pos', _firsts[k - 1] + u.start + u.body{sentence})))))"""
SENTENCE = ", 'sentence', substring(substring(_text, cast(_firsts[k - 1] as int) + 1, cast(_firsts[k] - _firsts[k - 1] as int)), cast(u.start as int) + 1, u.body)"


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """(key, sentence_no, start_pos, end_pos, sentence): the sentences of each text, end exclusive, in code points.

    A sentence runs from its first to its last non-blank character and never over a line end. Null, empty and blank texts
    have none. Rows with equal keys are cut each by itself. Other columns are ignored.
    """
    base = spread(df.select(F.col(key).alias("_id"), F.col(text).alias("_text")).filter("_text is not null and _text <> ''"))
    edge = rf"[\n{BLANK[1:-1]}]+"
    bare = lambda x: F.regexp_replace(x, f"^{edge}", "")
    part = lambda x: F.struct(F.length(x).alias("size"), (F.length(x) - F.length(bare(x))).alias("head"), F.length(F.regexp_replace(bare(x), f"{edge}$", "")).alias("body"))
    cut = base.withColumn("_pieces", pieces(F.col("_text"))).withColumn("_parts", F.transform("_pieces", part)).drop("_pieces")
    cut = cut.withColumn("_block", F.expr(BLOCK)).withColumn("_firsts", F.expr(FIRSTS))
    cut = cut.select("_id", F.posexplode(F.expr(UNITS.format(sentence=SENTENCE if with_text else ""))).alias("_no", "_unit"))
    return cut.select(F.col("_id").alias(key), (F.col("_no") + 1).alias("sentence_no"), "_unit.*")


def of_chosen(documents: DataFrame, chosen: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose key stands in chosen."""
    return documents.join(chosen.select(key).distinct(), key, "left_semi")
