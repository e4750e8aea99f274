"""Column expressions over terms that are N-Triples strings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shapeloom.sources.terms import RDF, XSD

#: Inclusive bounds of the derived integer types; None: no bound.  Fixed values of XML Schema.
INTEGERS = {
    "integer": (None, None),
    "nonPositiveInteger": (None, 0),
    "negativeInteger": (None, -1),
    "nonNegativeInteger": (0, None),
    "positiveInteger": (1, None),
    "long": (-(2**63), 2**63 - 1),
    "int": (-(2**31), 2**31 - 1),
    "short": (-(2**15), 2**15 - 1),
    "byte": (-128, 127),
    "unsignedLong": (0, 2**64 - 1),
    "unsignedInt": (0, 2**32 - 1),
    "unsignedShort": (0, 2**16 - 1),
    "unsignedByte": (0, 255),
}
_TZ = r"(?:Z|[+-](?:(?:0\d|1[0-3]):[0-5]\d|14:00))"
_DATE = r"-?(?:[1-9]\d{3,}|0\d{3})-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
_TIME = r"(?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?|24:00:00(?:\.0+)?)"
#: Lexical forms by local name of the datatype.
FORMS = {
    "decimal": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)",
    "double": r"(?:[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|[+-]?INF|NaN)",
    "float": r"(?:[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|[+-]?INF|NaN)",
    "boolean": r"(?:true|false|1|0)",
    "dateTime": f"{_DATE}T{_TIME}{_TZ}?",
    "date": f"{_DATE}{_TZ}?",
    "time": f"{_TIME}{_TZ}?",
    "duration": r"-?P(?=.)(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=.)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?",
    "yearMonthDuration": r"-?P(?=.)(?:\d+Y)?(?:\d+M)?",
    "dayTimeDuration": r"-?P(?=.)(?:\d+D)?(?:T(?=.)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?",
    **{k: r"[+-]?\d+" for k in INTEGERS},
}


def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def _quote(t: Column) -> Column:
    """Position of the closing quote of a literal (from 1); nothing behind it holds a quote."""
    return F.length(t) - F.instr(F.reverse(t), '"') + 1


def unescaped(text: Column) -> Column:
    swap = [(r"\\\\", "\0"), (r"\\n", "\n"), (r"\\r", "\r"), (r"\\t", "\t"), (r'\\"', '"'), ("\0", r"\\")]
    return F.when(F.contains(text, F.lit("\\")), reduce(lambda x, s: F.regexp_replace(x, *s), swap, text)).otherwise(text)


def escaped(text: Column) -> Column:
    swap = [(r"\\", r"\\\\"), ('"', r'\\"'), ("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")]
    return F.when(F.rlike(text, F.lit(r'[\\"\n\r\t]')), reduce(lambda x, s: F.regexp_replace(x, *s), swap, text)).otherwise(text)


def lex(t: Column) -> Column:
    """Lexical form of a literal, IRI without brackets, label of a blank node."""
    inner = F.when(is_iri(t), F.substring(t, F.lit(2), F.length(t) - 2)).when(is_blank(t), F.substring(t, 3, 1 << 30))
    return inner.otherwise(unescaped(F.substring(t, F.lit(2), _quote(t) - 2)))


def lang(t: Column) -> Column:
    """Language tag of a literal; empty where there is none, null for other terms."""
    tail = F.substring(t, _quote(t) + 1, F.lit(1 << 20))
    return F.when(is_literal(t), F.when(tail.startswith("@"), F.substring(tail, 2, 1 << 20)).otherwise(""))


def datatype(t: Column) -> Column:
    """Datatype IRI of a literal (no brackets); null for other terms."""
    tail = F.substring(t, _quote(t) + 1, F.lit(1 << 20))
    typed = F.when(tail.startswith("^^"), F.substring(tail, F.lit(4), F.length(tail) - 4))
    return F.when(is_literal(t), typed.when(tail.startswith("@"), RDF + "langString").otherwise(XSD + "string"))


def make_literal(text: Column, kind: str | None = None) -> Column:
    """A literal of a text, or of the text of a number or date (``kind``), which needs no escapes."""
    if kind is not None:
        return F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}{kind}>'))
    return F.concat(F.lit('"'), escaped(text), F.lit('"'))


def full(pattern: str) -> str:
    return f"^(?:{pattern})$"


def is_numeric(t: Column) -> Column:
    return _typed(t, FORMS["double"], ("float", "double")).isNotNull() | exact(t).isNotNull()


def has_type(t: Column, kind: str) -> Column:
    return t.endswith(f'"^^<{XSD}{kind}>')


def _typed(t: Column, form: str, kinds, group: int = 1) -> Column:
    """A group of the lexical form of a literal of one of the kinds; null for other terms.  Names the term once."""
    pattern = f'^"({form})"\\^\\^<{re.escape(XSD)}(?:{"|".join(kinds)})>$'
    return F.nullif(F.regexp_extract(t, pattern, group), F.lit(""))


def exact(t: Column) -> Column:
    """Value of an integer or decimal; null for other terms and for what 38 digits do not hold."""
    return _typed(t, FORMS["decimal"], ("decimal", *INTEGERS)).try_cast("decimal(38,18)")


def floating(t: Column) -> Column:
    """Value of any numeric literal as a double; NaN is null."""
    text = F.regexp_replace(_typed(t, FORMS["double"], ("decimal", "float", "double", *INTEGERS)), "INF", "Infinity")
    return F.nullif(text.try_cast("double"), F.lit(float("nan")))


def valid(t: Column, local: str | None = None) -> Column:
    """Whether the lexical form fits the datatype; unknown datatypes take every form."""
    x, out = lex(t), None
    names = [local] if local else list(FORMS)
    for name in names:
        fits = F.rlike(x, F.lit(full(FORMS[name]))) if name in FORMS else F.lit(True)
        low, high = INTEGERS.get(name, (None, None))
        if low is not None or high is not None:
            n = F.regexp_replace(x, r"^\+", "").try_cast("decimal(38,0)")
            fits = fits & (n >= low if low is not None else F.lit(True)) & (n <= high if high is not None else F.lit(True))
        if local:
            return F.coalesce(fits, F.lit(False))
        out = F.when(datatype(t) == XSD + name, fits) if out is None else out.when(datatype(t) == XSD + name, fits)
    return F.coalesce(out.otherwise(F.lit(True)), F.lit(False))


_HOUR = 3600 * 10**6


_DAYTIMES = ("dateTime", "date", "time")
_DURATIONS = ("duration", "yearMonthDuration", "dayTimeDuration")


def _instant(t: Column) -> tuple[Column, Column]:
    """(microseconds, time zone or an empty string) of a dateTime, date or time."""
    forms = {"dateTime": f"(?:{_DATE}T{_TIME})", "date": _DATE, "time": _TIME}
    text = {k: _typed(t, f"({form})({_TZ})?", (k,), 2) for k, form in forms.items()}
    full_ = F.when(has_type(t, "dateTime"), text["dateTime"]).when(has_type(t, "date"), F.concat(text["date"], F.lit("T00:00:00"))).when(has_type(t, "time"), F.concat(F.lit("1972-12-31T"), text["time"]))
    zone = F.regexp_extract(t, f'({_TZ})"[^"]*$', 1)
    return F.unix_micros(F.try_to_timestamp(F.concat(full_, F.coalesce(F.nullif(zone, F.lit("")), F.lit("Z"))))), zone != ""


def _duration(t: Column) -> tuple[Column, Column]:
    """(months, microseconds) of a duration."""
    x = lex(t)
    part = lambda unit, head: F.coalesce(F.regexp_extract(x, f"{head}(\\d+(?:\\.\\d+)?){unit}", 1).try_cast("decimal(30,6)"), F.lit(0))
    sign = F.when(x.startswith("-"), -1).otherwise(1)
    date, time = "^[^T]*?", "T[^T]*?"
    ok = F.rlike(x, F.lit(full(FORMS["duration"])))
    months = sign * (part("Y", date) * 12 + part("M", date))
    seconds = sign * (part("D", date) * 86400 + part("H", time) * 3600 + part("M", time) * 60 + part("S", time))
    return F.when(ok, months), F.when(ok, seconds)


def _order(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def parsed(t: Column) -> Column:
    """What ``compare_parsed`` needs of a term: only what its datatype calls for is parsed."""
    kind = datatype(t)
    of = lambda *names: kind.isin([XSD + n for n in names])
    moment, zoned = _instant(t)
    months, seconds = _duration(t)
    return F.struct(
        F.when(of("decimal", *INTEGERS), exact(t)).alias("exact"),
        F.when(of("float", "double", "decimal", *INTEGERS), floating(t)).alias("number"),
        F.when(of("string"), lex(t)).alias("text"),
        F.when(of(*_DAYTIMES), F.struct(kind.alias("kind"), moment.alias("at"), zoned.alias("zoned"))).alias("moment"),
        F.when(of(*_DURATIONS), F.struct(months.alias("months"), seconds.alias("seconds"))).alias("span"),
    )


def compare_parsed(a: Column, b: Column) -> Column:
    """-1, 0 or 1 where two parsed terms are comparable, else null."""
    out = [_order(a["exact"], b["exact"]), _order(a["number"], b["number"]), _order(a["text"], b["text"])]
    x, y, far = a["moment"], b["moment"], 14 * _HOUR
    apart = F.when(x["at"] + far < y["at"], -1).when(x["at"] - far > y["at"], 1)
    out.append(F.when(x["kind"] == y["kind"], F.when(x["zoned"] == y["zoned"], _order(x["at"], y["at"])).otherwise(apart)))
    # Months last 28 to 31 days: ordered only if that leaves no doubt.
    months, seconds, day = a["span"]["months"] - b["span"]["months"], a["span"]["seconds"] - b["span"]["seconds"], 86400
    low, high = months * 28 * day + seconds, months * 31 * day + seconds
    out.append(F.when((months == 0) & (seconds == 0), 0).when(F.greatest(low, high) < 0, -1).when(F.least(low, high) > 0, 1))
    return F.coalesce(*out)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 where two terms are comparable, else null."""
    return compare_parsed(parsed(a), parsed(b))


def compare_text(a: Column, b: Column, kind: str) -> Column:
    """``compare`` for one kind of values that the caller knows both sides to have."""
    return _order(exact(a), exact(b)) if kind == "exact" else compare(a, b)


def java_pattern(pattern: str, flags: str | None) -> str | None:
    """The pattern with its flags, or None where the pattern is invalid (such a facet fails for every value)."""
    flags = flags or ""
    if set(flags) - set("ismx") or re.search(r"\(\?[=!<]|\\[1-9]", pattern):
        return None
    try:
        re.compile(re.sub(r"\\[pP]\{[^}]*\}|\\[icIC]", ".", pattern))
    except re.error:
        return None
    return f"(?{''.join(sorted(set(flags)))}){pattern}" if flags else pattern


def facet(t: Column, name: str, value) -> Column:
    """Whether a term satisfies a facet; never null."""
    from pyspark.sql.functions import lit

    if name == "datatype":
        local = value[len(XSD) :] if value.startswith(XSD) else "?"
        found = (datatype(t) == value) & valid(t, local)
    elif name in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"):
        c = compare(t, lit(value))
        found = {"minI": c >= 0, "maxI": c <= 0, "minE": c > 0, "maxE": c < 0}[name[:4]]
    elif name in ("minLength", "maxLength"):
        n = F.when(~is_blank(t), F.char_length(lex(t)))
        found = n >= value if name == "minLength" else n <= value
    elif name == "pattern":
        pattern = java_pattern(*value)
        found = ~is_blank(t) & F.rlike(lex(t), lit(pattern)) if pattern is not None else lit(False)
    elif name == "languageIn":
        tag = F.lower(lang(t))
        ranges = [(tag != "") if r == "*" else (tag == r.lower()) | tag.startswith(r.lower() + "-") for r in value]
        found = reduce(lambda a, b: a | b, ranges, lit(False))
    elif name == "nodeKind":
        tests = {"IRI": is_iri(t), "BlankNode": is_blank(t), "Literal": is_literal(t)}
        found = reduce(lambda a, b: a | b, [v for k, v in tests.items() if k in value], lit(False))
    elif name == "in":
        found = t.isin(list(value)) if value else lit(False)
    else:
        raise ValueError(f"unknown facet {name}")
    return F.coalesce(found, lit(False))
