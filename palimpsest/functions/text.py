"""Text functions: every one maps columns to a column and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.options import CompareOptions

# ---- fixed values -----------------------------------------------------------
# White space as JavaScript's \s sees it.
WS = (r"\t\n\x{0b}\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
      r"\x{3000}\x{feff}")
# Characters that are tokens of their own.
CJK_TOKEN = (r"\x{2e80}-\x{2fff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
             r"\x{f900}-\x{faff}\x{ac00}-\x{d7af}\x{3000}-\x{303f}\x{ff00}-\x{ffef}")
# Characters counted as one word each.
CJK_WORD = (r"\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}"
            r"\x{ac00}-\x{d7af}")
# Characters between which recognised text carries no space.
CJK_OCR = r"\x{3000}-\x{303f}\x{3400}-\x{9fff}\x{ff00}-\x{ffef}"
WORD_RE = rf"[{CJK_TOKEN}]|[\p{{L}}\p{{N}}_]+(?:['’]\p{{L}}+)*|[{WS}]+|[^{WS}]"
CHAR_RE = rf"(?s)[{WS}]+|."
# The same tokens without those of white space (the ideographic space lies in the CJK class).
SOLID_WORD_RE = rf"[{CJK_TOKEN}&&[^{WS}]]|[\p{{L}}\p{{N}}_]+(?:['’]\p{{L}}+)*|[^{WS}]"
SOLID_CHAR_RE = rf"(?s)[^{WS}]"
# What these classes come to in a text of ASCII only, where matching them is several times quicker.
ASCII_WS = r"\t\n\x0b\f\r "
ASCII_WORD_RE = rf"[A-Za-z0-9_]+(?:'[A-Za-z]+)*|[{ASCII_WS}]+|[^{ASCII_WS}]"
ASCII_SOLID_WORD_RE = rf"[A-Za-z0-9_]+(?:'[A-Za-z]+)*|[^{ASCII_WS}]"
WS_CHARS = "\t\n\x0b\f\r \xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
# Wide punctuation and its narrow form, position by position; the ellipsis widens to three dots.
PUNCT_WIDE = "，。、：；！？（）【】《》“”‘’「」『』～—–－\u3000"
PUNCT_NARROW = ",.,:;!?()[]<>\"\"''\"\"\"\"~--- "
QUOTES_SINGLE = "‘’‚‛′"
QUOTES_DOUBLE = "“”„‟″"
CELL_KEY = "\u0001cell"
IMG_KEY = "\u0002img:"
# -----------------------------------------------------------------------------

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
# The explicit pairs win over the constant shift where both name a character.
_EXTRA = [(w, n) for w, n in zip(_FULL, _HALF) if w not in PUNCT_WIDE]


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _extract(text: Column, ascii_re: str, full_re: str) -> Column:
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(is_ascii(text), found(ascii_re)).otherwise(found(full_re))


def word_tokens(text: Column) -> Column:
    return _extract(text, ASCII_WORD_RE, WORD_RE)


def solid_words(text: Column) -> Column:
    """``word_tokens`` without those of white space."""
    return _extract(text, ASCII_SOLID_WORD_RE, SOLID_WORD_RE)


def char_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHAR_RE), F.lit(0))


def is_ws(t: Column) -> Column:
    return t.rlike(rf"^[{WS}]+$")


def is_ws_token(t: Column) -> Column:
    """``is_ws`` for a token: tokens hold either white space only or none, so one character tells."""
    return F.contains(F.lit(WS_CHARS), F.substring(t, 1, 1))


def strip_ws(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{WS}]+", "")


def visible(text: Column, o: CompareOptions) -> Column:
    """A text as far as it is compared when white space is not: quotes and case folded, white space left out."""
    folded = fold_quotes(text) if o.norm_quotes else text
    low = lambda c: F.lower(c) if o.ignore_case else c
    return F.when(is_ascii(text), F.regexp_replace(low(text), rf"[{ASCII_WS}]+", "")).otherwise(strip_ws(low(folded)))


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+$", "")


def squeeze(text: Column) -> Column:
    """White-space runs become one blank, both ends are trimmed."""
    return F.trim(F.regexp_replace(text, rf"[{WS}]+", " "))


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def short(text: Column, n: int = 120) -> Column:
    return clip(squeeze(text), n)


def fold_punct(t: Column) -> Column:
    """Wide to narrow for a token that is exactly one character; other tokens stay."""
    wide = PUNCT_WIDE + "".join(w for w, _ in _EXTRA)
    narrow = PUNCT_NARROW + "".join(n for _, n in _EXTRA)
    return (F.when(t == "…", F.lit("..."))
            .when(F.length(t) == 1, F.translate(t, wide, narrow))
            .otherwise(t))


def fold_quotes(t: Column) -> Column:
    return F.translate(t, QUOTES_SINGLE + QUOTES_DOUBLE,
                       "'" * len(QUOTES_SINGLE) + '"' * len(QUOTES_DOUBLE))


def has_quotes(text: Column) -> Column:
    """Whether ``fold_quotes`` would change anything: quicker than folding, which looks every character up."""
    return ~is_ascii(text) & text.rlike(r"[\x{2018}-\x{201f}\x{2032}\x{2033}]")


def word_key(t: Column, o: CompareOptions) -> Column:
    """``norm_key`` of a token that is not white space."""
    k = fold_punct(t) if o.norm_punct else t
    k = fold_quotes(k) if o.norm_quotes else k
    return F.lower(k) if o.ignore_case else k


def blank_key(t: Column, o: CompareOptions) -> Column:
    """``norm_key`` of a token of white space."""
    return F.lit(" ") if o.ignore_ws else F.translate(word_key(t, o), "\xa0", " ")


def norm_key(t: Column, o: CompareOptions) -> Column:
    """The form of a token under which it is compared."""
    return F.when(is_ws_token(t), blank_key(t, o)).otherwise(word_key(t, o))


def is_folded(text: Column, o: CompareOptions) -> Column:
    """Whether ``word_key`` surely leaves every token of a text as it is."""
    if o.norm_punct:
        return F.lit(False)
    plain = ~has_quotes(text) if o.norm_quotes else text.isNotNull()
    return plain & (F.lower(text) == text) if o.ignore_case else plain


def fp_norm(text: Column) -> Column:
    """Paragraph text as it is fingerprinted: no white space, lower case."""
    return F.lower(strip_ws(text))


def norm_name(name: Column) -> Column:
    return F.lower(strip_ws(name))


def is_anonymous(name: Column) -> Column:
    return trim_ws(name).rlike(r"(?i)^(作者|author|unknown|未知)?$")


def initials_of(name: Column) -> Column:
    """First character of a Chinese name; else first letters of the first two parts."""
    n = trim_ws(name)
    parts = F.filter(F.split(n, rf"[{WS}._-]+"), lambda p: p != "")
    two = F.upper(F.concat(F.substring(F.try_element_at(parts, F.lit(1)), 1, 1),
                           F.substring(F.try_element_at(parts, F.lit(2)), 1, 1)))
    return (F.when(n == "", F.lit(""))
            .when(n.rlike(r"^[㐀-鿿]"), F.substring(n, 1, 1))
            .when(F.size(parts) >= 2, two)
            .otherwise(F.upper(F.substring(n, 1, 2))))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".\.([^.]*)$", 1))


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.(docx|pdf|txt|md)$", "")


def clean_stem(path: Column) -> Column:
    """Base name without extension, copy counters and suffixes of earlier exports."""
    base = base_name(path)
    s = F.regexp_replace(stem_of(base), r"( \(\d+\))+$", "")
    s = F.regexp_replace(s, r"(?i)(-(我方意见|定稿|our comments|final))+$", "")
    return F.when(s == "", base).otherwise(s)


def safe_name(s: Column) -> Column:
    return trim_ws(F.regexp_replace(s, r'[\\/:*?"<>|]', "_"))


def fill_name(pattern: Column, path: Column, day: Column, ver: Column, who: Column) -> Column:
    """Tags {name} {date} {date:…-…} {ver} {who}; an empty tag takes one separator with it."""
    gap = "\u0000"
    s = pattern

    def put(s: Column, tag: str, value: Column) -> Column:
        v = safe_name(F.coalesce(value, F.lit("")))
        v = F.when(v == "", F.lit(gap)).otherwise(v)
        quoted = F.regexp_replace(v, r"([\\$])", r"\\$1")  # the replacement is literal text
        return F.regexp_replace(s, F.lit(tag), quoted)

    s = put(s, r"\{name(?::[^}]*)?\}", clean_stem(path))
    s = put(s, r"\{date:[^}]*-[^}]*\}", F.date_format(day, "yyyy-MM-dd"))
    s = put(s, r"\{date(?::[^}]*)?\}", F.date_format(day, "yyyyMMdd"))
    s = put(s, r"\{ver(?::[^}]*)?\}", ver)
    s = put(s, r"\{who(?::[^}]*)?\}", who)
    s = F.regexp_replace(s, rf"([-_ ·]){gap}[-_ ·]", "$1")
    return F.regexp_replace(s, rf"[-_ ·]?{gap}[-_ ·]?", "")


def draft_name(pattern: Column, path: Column, suffix: Column, day: Column, ver: Column,
               who: Column) -> Column:
    stem = safe_name(fill_name(pattern, path, day, ver, who))
    stem = F.when(stem == "", F.lit("revision")).otherwise(stem)
    return F.concat(stem, suffix, F.lit(".docx"))


def clean_ocr(text: Column) -> Column:
    t = F.regexp_replace(text, rf"([{CJK_OCR}])[ \t]+(?=[{CJK_OCR}])", "$1")
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    return trim_ws(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def mask_digits(text: Column) -> Column:
    """Line with every number as # and without white space, so page numbers agree."""
    return strip_ws(F.regexp_replace(text, r"\d+", "#"))


PAGE_NUMBER_RE = (r"(?i)^[-–—]?\s*(第\s*)?\d*\s*页?\s*([/／]|共|of)?\s*\d*\s*页?\s*[-–—]?$",
                  r"(?i)^page\s*\d*\s*(of\s*\d*)?$")


def is_page_number(text: Column) -> Column:
    s = squeeze(text)
    return (s == "") | s.rlike(PAGE_NUMBER_RE[0]) | s.rlike(PAGE_NUMBER_RE[1])


CN_NUM = r"[一二三四五六七八九十百零〇两\d]+"
CLAUSE_RE = (rf"(?i)^[{WS}]*(第[{WS}]*{CN_NUM}[{WS}]*[条章节款部分篇]|Article[{WS}]+[\dIVXLC]+"
             rf"|Section[{WS}]+\d+(\.\d+)*|Clause[{WS}]+\d+"
             rf"|\d{{1,2}}(\.\d{{1,2}}){{0,2}}[、.．][{WS}]*[^{WS}]|[一二三四五六七八九十]+、)")
CLAUSE_PREFIX_RE = rf"^(第 ?{CN_NUM} ?条) ?([^ ，。,.:：;；]{{0,12}})"


def clause_title(text: Column, kind: Column) -> Column:
    """Title of the clause a block opens, or null."""
    s = squeeze(text)
    head = F.regexp_extract(s, CLAUSE_PREFIX_RE, 1)
    tail = F.regexp_extract(s, CLAUSE_PREFIX_RE, 2)
    return (F.when((kind == "tr") | (s == ""), F.lit(None).cast("string"))
            .when(kind == "h", clip(s, 28))
            .when((F.length(s) <= 40) & s.rlike(CLAUSE_RE), clip(s, 28))
            .when(head != "", F.trim(F.concat(head, F.lit(" "), tail))))


def is_doc_title(text: Column, kind: Column, first: Column) -> Column:
    """The first heading that is not worded as a clause names the document."""
    return first & (kind == "h") & ~text.rlike(CLAUSE_RE)


def count_cjk(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[{CJK_WORD}]"))


def count_words(text: Column) -> Column:
    latin = F.regexp_replace(text, rf"[{CJK_WORD}]", " ")
    return count_cjk(text) + F.regexp_count(latin, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'’_-]*"))


def count_chars_no_space(text: Column) -> Column:
    return F.length(strip_ws(text))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two names."""
    n = F.least(F.length(a), F.length(b))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    one = F.lit(1)
    return F.aggregate(
        steps, F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (F.substr(a, i, one) == F.substr(b, i, one)), i)
        .otherwise(acc))


NAME_SEP = r"[-_ .·—–（）()\[\]【】]"


def _on_boundary(name: Column, n: Column) -> Column:
    """The largest length up to n at which the name may be cut: beside a separator, or 0."""
    at = lambda k: F.substr(name, k, F.lit(1)).rlike(NAME_SEP)
    ks = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    fit = F.filter(ks, lambda k: at(k) | (k == F.length(name)) | at(k + 1))
    return F.coalesce(F.array_max(fit), F.lit(0))


def pair_name(a_name: Column, b_name: Column) -> Column:
    """STRUCT<common, a, b>: the shared part of two file names and what differs; null when there is no
    shared part of two characters or a side has nothing of its own."""
    a, b = stem_of(a_name), stem_of(b_name)
    p0 = common_prefix(a, b)
    tail = lambda x: F.reverse(F.substr(x, p0 + 1))
    s0 = common_prefix(tail(a), tail(b))
    p = F.least(_on_boundary(a, p0), _on_boundary(b, p0))
    s = F.least(_on_boundary(F.reverse(a), s0), _on_boundary(F.reverse(b), s0))
    strip = lambda x: F.regexp_replace(x, r"^[-_ .·—–]+|[-_ .·—–]+$", "")
    pre, suf = strip(F.substr(a, F.lit(1), p)), strip(F.substr(a, F.length(a) - s + 1, s))
    own = lambda x: strip(F.substr(x, p + 1, F.length(x) - s - p))
    common = F.when((pre != "") & (suf != ""), F.concat(pre, F.lit("-"), suf)).otherwise(F.concat(pre, suf))
    ok = (a != b) & (F.length(common) >= 2) & (own(a) != "") & (own(b) != "")
    return F.when(ok, F.struct(common.alias("common"), own(a).alias("a"), own(b).alias("b")))


def find_hits(text: Column, needle: str) -> Column:
    """0-based offsets of the non-overlapping, case-insensitive hits of a literal."""
    q = needle.lower()
    parts = F.split(F.lower(text), "\\Q" + q + "\\E", -1)
    lens = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
                       lambda p: F.length(p))
    acc = F.aggregate(
        lens,
        F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("pos")),
        lambda s, n: F.struct(
            F.concat(s["at"], F.array(s["pos"] + n)).alias("at"),
            (s["pos"] + n + F.lit(len(q))).alias("pos")))
    return acc["at"]


def fmt_bytes(n: Column) -> Column:
    return (F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
            .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
            .otherwise(F.concat(F.format_string("%.2f", n / 1024 / 1024), F.lit(" MB"))))


# ---- list numbers -----------------------------------------------------------
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"),
         (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
ZH_DIGITS = "零一二三四五六七八九"


def roman(n: Column) -> Column:
    """Each step writes as many of one sign as fit into what the larger signs left over."""
    pieces, rest = [], n
    for value, sign in ROMAN:
        pieces.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.concat(*pieces)


def zh_count(n: Column) -> Column:
    digit = lambda k: F.substr(F.lit(ZH_DIGITS), k + 1, F.lit(1))
    unit = F.when(n % 10 != 0, digit((n % 10).cast("int"))).otherwise("")
    return (F.when(n < 10, digit(n.cast("int")))
            .when(n < 20, F.concat(F.lit("十"), unit))
            .when(n < 100, F.concat(digit(F.floor(n / 10).cast("int")), F.lit("十"), unit))
            .otherwise(n.cast("string")))


def list_number(n: Column, fmt: Column) -> Column:
    letters = "abcdefghijklmnopqrstuvwxyz"
    letter = F.substr(F.lit(letters), ((n - 1) % 26 + 1).cast("int"), F.lit(1))
    circled = F.when(n <= 20, F.substr(F.lit(CIRCLED), n.cast("int"), F.lit(1))) \
        .otherwise(n.cast("string"))
    return (F.when(fmt == "lowerLetter", letter)
            .when(fmt == "upperLetter", F.upper(letter))
            .when(fmt == "lowerRoman", F.lower(roman(n)))
            .when(fmt == "upperRoman", roman(n))
            .when(fmt.isin("chineseCounting", "chineseCountingThousand", "ideographTraditional",
                           "chineseLegalSimplified"), zh_count(n))
            .when(fmt.isin("decimalEnclosedCircle", "decimalEnclosedCircleChinese"), circled)
            .otherwise(n.cast("string")))
