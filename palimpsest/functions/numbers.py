"""Numbers, units and dates in changed text, and the risk they state. JVM-side columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import text as T

# ---- fixed values -----------------------------------------------------------
ZH_NUMBER_CHARS = "零〇一二两三四五六七八九十百千万亿"
ZH_DIGIT = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
ZH_UNIT = {"十": 10, "百": 100, "千": 1000}
ZH_BIG = {"万": 10_000, "亿": 100_000_000}
NUM_RE = rf"(?:\d{{1,3}}(?:[,，]\d{{3}})+|\d+)(?:\.\d+)?(?:[{T.WS}]*[万亿])?|[{ZH_NUMBER_CHARS}]{{1,10}}"
CURRENCY_RIGHT = rf"(?i)^[{T.WS}]*(万元|亿元|元|人民币|美元|欧元|港元|USD|RMB|CNY|EUR|dollars?)"
CURRENCY_LEFT = rf"(?i)(人民币|RMB|CNY|USD|EUR|US\$|\$|¥|￥|€)[{T.WS}]*$"
PERCENT_RIGHT = rf"(?i)^[{T.WS}]*(%|％|个百分点|percent)"
DURATION_RIGHT = (rf"(?i)^[{T.WS}]*(个工作日|工作日|个自然日|自然日|日|天|个月|月|年|周|星期|小时"
                  r"|business days?|days?|months?|years?|weeks?|hours?)")
ORDINAL_LEFT, ORDINAL_RIGHT = rf"第[{T.WS}]*$", rf"^[{T.WS}]*[条款章节页项部篇]"
MONEY_CLAUSE = r"(?i)费用|价款|价格|金额|支付|付款|报酬|结算|违约金|price|fee|payment|amount"
DATE_RES = (rf"(\d{{4}})[{T.WS}]*年[{T.WS}]*(\d{{1,2}})[{T.WS}]*月[{T.WS}]*(\d{{1,2}})[{T.WS}]*日",
            r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})")
CONTEXT = 8
# All characters a number or a date can hold.
WITHIN = rf"[\d,，.{T.WS}{ZH_NUMBER_CHARS}年月日/-]*"
# -----------------------------------------------------------------------------


def parse_zh_number(s: Column) -> Column:
    """十二 → 12, 三万五千 → 35000; null when another character occurs."""
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in (kv[0], float(kv[1]))])
    digits, units, bigs = table(ZH_DIGIT), table(ZH_UNIT), table(ZH_BIG)

    def step(acc: Column, c: Column) -> Column:
        digit, unit, big = F.try_element_at(digits, c), F.try_element_at(units, c), F.try_element_at(bigs, c)
        zero = F.lit(0.0)
        times = F.when(acc["num"] == 0, 1.0).otherwise(acc["num"])
        return F.struct(
            F.when(big.isNotNull(), acc["total"] + (acc["section"] + acc["num"]) * big).otherwise(acc["total"]).alias("total"),
            F.when(big.isNotNull(), zero).when(unit.isNotNull(), acc["section"] + times * unit).otherwise(acc["section"]).alias("section"),
            F.when(digit.isNotNull(), digit).otherwise(zero).alias("num"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("section"), F.lit(0.0).alias("num"))
    acc = F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), start, step)
    return F.when(s.rlike(rf"^[{ZH_NUMBER_CHARS}]+$"), acc["total"] + acc["section"] + acc["num"])


def parse_num(raw: Column) -> Column:
    """1,200.5 → 1200.5, 3万 → 30000, Chinese numerals; null when not a number."""
    s = T.strip_ws(raw)
    times = F.when(s.endswith("万"), 1e4).when(s.endswith("亿"), 1e8).otherwise(1.0)
    digits = F.regexp_replace(F.regexp_replace(s, "[万亿]$", ""), "[,，]", "")
    return F.when(s.rlike(r"^[\d,，.]+[万亿]?$"), digits.try_cast("double") * times).otherwise(parse_zh_number(s))


def hits(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<s, e, txt>> of all matches with their 0-based offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<s:int,e:int,txt:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["pos"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(F.struct(
            s.alias("s"), e.alias("e"), x["m"].alias("txt")))).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def _overlapping(text: Column, pattern: str, start: Column, end: Column) -> Column:
    """The ``hits`` of a number or date pattern that overlap [start, end). No match goes beyond the characters it may
    hold, so only these are searched around the span, not the whole text."""
    to = F.greatest(start, end)
    left = F.length(F.regexp_extract(F.reverse(F.substr(text, F.lit(1), start)), "^" + WITHIN, 0))
    right = F.length(F.regexp_extract(F.substr(text, to + 1), "^" + WITHIN, 0))
    at = F.transform(F.array(start - left), lambda at: F.transform(
        hits(F.substr(text, at + 1, to + right - at), pattern),
        lambda h: F.struct((h["s"] + at).alias("s"), (h["e"] + at).alias("e"), h["txt"].alias("txt"))))
    return F.filter(F.flatten(at), lambda h: (h["e"] > start) & (h["s"] < F.greatest(end, start + 1)))


def _with_context(text: Column, h: Column) -> Column:
    left = F.substr(text, F.greatest(h["s"] - CONTEXT, F.lit(0)) + 1, F.least(h["s"], F.lit(CONTEXT)))
    return F.struct(parse_num(h["txt"]).alias("value"), h["s"].alias("s"), h["e"].alias("e"), h["txt"].alias("txt"),
                    left.alias("left"), F.substr(text, h["e"] + 1, F.lit(CONTEXT)).alias("right"))


def number_at(text: Column, start: Column, end: Column) -> Column:
    """The first number that overlaps [start, end): STRUCT<value, s, e, txt, left, right> or null."""
    near = F.transform(_overlapping(text, NUM_RE, start, end), lambda h: _with_context(text, h))
    return F.try_element_at(F.filter(near, lambda h: h["value"].isNotNull()), F.lit(1))


def first_amount(text: Column) -> Column:
    """The first number with a currency mark beside it."""
    near = F.transform(hits(text, NUM_RE), lambda h: _with_context(text, h))
    return F.try_element_at(F.filter(near, lambda h: h["value"].isNotNull() & has_currency(h)), F.lit(1))


def _date(txt: Column, pattern: str) -> Column:
    part = lambda i: F.regexp_extract(txt, pattern, i).try_cast("int")
    year = F.when(part(1) < 100, part(1) + 1900).otherwise(part(1))
    # Days and months beyond the calendar roll over.
    return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), part(2) - 1), part(3) - 1)


def date_at(text: Column, start: Column, end: Column) -> Column:
    """The date that overlaps [start, end): STRUCT<d, txt> or null."""
    def of(p: str) -> Column:
        return F.transform(_overlapping(text, p, start, end),
                           lambda h: F.struct(_date(h["txt"], p).alias("d"), h["txt"].alias("txt")))

    found = [of(p) for p in DATE_RES]
    return F.try_element_at(F.filter(F.concat(*found), lambda x: x["d"].isNotNull()), F.lit(1))


def has_currency(h: Column) -> Column:
    return h["right"].rlike(CURRENCY_RIGHT) | h["left"].rlike(CURRENCY_LEFT)


def has_percent(h: Column) -> Column:
    return h["right"].rlike(PERCENT_RIGHT)


def has_duration(h: Column) -> Column:
    return h["right"].rlike(DURATION_RIGHT)


def is_ordinal(h: Column) -> Column:
    return h["left"].rlike(ORDINAL_LEFT) & h["right"].rlike(ORDINAL_RIGHT)


def unit_of(h: Column) -> Column:
    right = [F.regexp_extract(h["right"], p, 1) for p in (CURRENCY_RIGHT, PERCENT_RIGHT, DURATION_RIGHT)]
    out = F.when(right[0] != "", right[0]).when(right[1] != "", right[1]).when(right[2] != "", right[2])
    return out.otherwise(F.regexp_extract(h["left"], CURRENCY_LEFT, 1))


def day_delta(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def month_delta(a: Column, b: Column) -> Column:
    """Whole months between two dates on the same day of the month, else 0."""
    m = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return F.when(F.dayofmonth(a) == F.dayofmonth(b), m).otherwise(0)


def pdf_date(s: Column) -> Column:
    """D:YYYYMMDDhhmmss with optional tail → yyyy-MM-dd hh:mm:ss; other texts stay."""
    p = r"D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?"
    g = lambda i, d: F.when(F.regexp_extract(s, p, i) == "", d).otherwise(F.regexp_extract(s, p, i))
    out = F.concat(g(1, ""), F.lit("-"), g(2, "01"), F.lit("-"), g(3, "01"), F.lit(" "), g(4, "00"), F.lit(":"), g(5, "00"),
                   F.lit(":"), g(6, "00"))
    return F.when(s.rlike(p), out).otherwise(s)


def word_date(local: Column, utc: Column, zone: str) -> Column:
    """Instant of a comment as UTC text: the recorded UTC time, else the local clock in ``zone``."""
    fill = lambda c: F.when(F.length(c) == 10, F.concat(c, F.lit(" 00:00:00"))).when(F.length(c) == 16, F.concat(c, F.lit(":00"))).otherwise(c)
    clean = lambda c: fill(F.regexp_replace(F.regexp_extract(
        c, r"^(\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?)?)", 1), "T", " "))
    at = lambda c: F.try_to_timestamp(clean(c), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    moved = F.convert_timezone(F.lit(zone), F.lit("UTC"), at(local))
    return F.date_format(F.coalesce(at(utc), moved), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")


# ---- risks --------------------------------------------------------------------------------------------
RISK = ("struct<cat:string,k:string,a:double,b:double,unit:string,pct:double,"
        "days:int,months:int,da:string,db:string,removed:boolean>")


def _risk(cat: str, k: str, **f: Column) -> Column:
    types = {"a": "double", "b": "double", "unit": "string", "pct": "double", "days": "int", "months": "int",
             "da": "string", "db": "string", "removed": "boolean"}
    return F.struct(F.lit(cat).alias("cat"), F.lit(k).alias("k"),
                    *[f.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def modified_risk(na: Column, nb: Column, da: Column, db: Column, clause: Column, money: bool, date: bool) -> Column:
    """Risk of a replaced text from its numbers and dates on both sides, or null."""
    dated = F.lit(date) & da.isNotNull() & db.isNotNull() & (da["txt"] != db["txt"])
    d = _risk("date", "date", da=da["txt"], db=db["txt"], days=day_delta(da["d"], db["d"]), months=month_delta(da["d"], db["d"]))
    differ = na.isNotNull() & nb.isNotNull() & (na["value"] != nb["value"]) & ~is_ordinal(na) & ~is_ordinal(nb)
    unit = F.when(unit_of(nb) != "", unit_of(nb)).otherwise(unit_of(na))
    pct = has_percent(nb) | has_percent(na)
    cur = has_currency(nb) | has_currency(na)
    dur = has_duration(nb) | has_duration(na)
    a, b = na["value"], nb["value"]
    share = F.when(a != 0, (b - a) / F.when(a != 0, a))
    return (F.when(dated, d)
            .when(differ & pct & F.lit(money), _risk("money", "percent", a=a, b=b))
            .when(differ & ~(pct & F.lit(money)) & F.lit(money) & (cur | (~dur & F.coalesce(clause, F.lit("")).rlike(MONEY_CLAUSE))),
                  _risk("money", "money", a=a, b=b, unit=unit, pct=share))
            .when(differ & F.lit(date) & dur, _risk("term", "term", a=a, b=b, unit=unit)))


def new_amount_risk(amount: Column, removed: Column) -> Column:
    return F.when(amount.isNotNull(), _risk("money", "amount-new", b=amount["value"], unit=unit_of(amount), removed=removed))


def keyword_hits(words: list[str], *texts: Column) -> Column:
    """The keywords found in any of the texts, case-insensitive, in their given order."""
    kept = [w.strip() for w in words if w.strip()]
    low = [F.lower(F.coalesce(x, F.lit(""))) for x in texts]
    found = [F.when(F.greatest(*[F.contains(x, F.lit(w.lower())) for x in low]), F.lit(w)) for w in kept]
    if not found:
        return F.array().cast("array<string>")
    return F.filter(F.array(*found), lambda x: x.isNotNull())
