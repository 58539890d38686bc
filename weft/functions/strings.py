"""String actions as Column functions. All of them stay in generated JVM code.

A null input gives null, unless a function says otherwise. Patterns are checked on the
driver where the plan is built: a bad one raises ``ValueError`` then. Look-around and
back references are refused, as the pattern language has none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and what they are folded to.
FOLD_FROM = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿ"
FOLD_TO = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOOooooooUUUUuuuuYyy"
FOLD_LONG = {"Æ": "AE", "æ": "ae", "ẞ": "SS", "ß": "ss"}

#: Two code points that no text has: they are set aside for use inside of programs.
_OPENS, _CLOSES = "\uFDD0", "\uFDD1"


def quoted(text: str) -> str:
    """A Java pattern that matches the text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E" if text else ""


def checked(pattern: str) -> str:
    """The pattern, if it is one without look-around and back references."""
    try:
        re.compile(re.sub(r"\(\?P?<([A-Za-z]\w*)>", r"(?P<\1>", re.sub(r"\\[pP](\{\^?\w+\}|\w)", r"\\w", pattern)).replace("\\z", "\\Z"))
    except re.error as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from e
    plain = re.sub(r"\\\\", "", pattern)
    if re.search(r"\(\?(=|!|<=|<!)|\\[1-9]", plain):
        raise ValueError(f"pattern {pattern!r} has look-around or a back reference")
    return re.sub(r"\(\?P<", "(?<", pattern)


def _apart(pattern: str) -> str:
    """The pattern without empty matches right after the match before, which other engines give and this language has not."""
    return f"(?>{pattern})(?:(?!\\G)|\\A)"


def _groups(pattern: str) -> tuple[int, set[str]]:
    names = set(re.findall(r"\(\?P?<([A-Za-z]\w*)>", pattern))
    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern)
    return len(re.findall(r"\((?!\?)", plain)) + len(names), names


def _template(text: str, pattern: str) -> str:
    """A replacement with ``$1``, ``${1}``, ``$name`` and ``$$`` as Java writes it; unknown groups are empty."""
    n, names = _groups(pattern)

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return "\\$"
        if m[1] is None and m[2] is None:
            return "\\" + m[0] if m[0] in "\\$" else m[0]
        name = m[1] or m[2]
        if name.isdigit():
            return f"${int(name)}" if int(name) <= n else ""
        return f"${{{name}}}" if name in names else ""

    out, last = [], 0
    for m in re.finditer(r"\$\$|\$\{(\w+)\}|\$(\w+)|[\\$]", text):
        out.append(text[last : m.start()])
        piece = one(m)
        # A digit after a group number would be read as part of it.
        if re.fullmatch(r"\$\d+", piece) and text[m.end() : m.end() + 1].isdigit():
            piece += "\\"
        out.append(piece)
        last = m.end()
    return "".join([*out, text[last:]])


def concatenate(*parts: Column, separator: str = "") -> Column:
    """Parts in the order given; nulls are left out. Without parts: the empty text."""
    return F.concat_ws(separator, *parts)


def split(s: Column, delimiter: str) -> Column:
    return F.array(s) if delimiter == "" else F.split(s, quoted(delimiter), -1)


def join(items: Column, separator: str = "") -> Column:
    return F.array_join(items, separator)


def trim(s: Column, cutset: str = "") -> Column:
    """Without ``cutset`` Unicode white space goes at both ends, else any of its characters."""
    if cutset == "":
        space = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
        return F.regexp_replace(s, f"^{space}+|{space}+$(?!\\n)", "")
    return F.btrim(s, F.lit(cutset))


def replace(s: Column, old: str, new: str, count: int = -1, use_regex: bool = False) -> Column:
    """All matches, or the first ``count``. With a count the replacement of a pattern is taken literally."""
    if count == 0:
        return s
    pattern = checked(old) if use_regex else quoted(old)
    literal = F.lit(new.replace("\\", "\\\\").replace("$", "\\$"))
    if count < 0:
        if use_regex:
            return F.regexp_replace(s, F.lit(_apart(pattern)), F.lit(_template(new, pattern)))
        return F.replace(s, F.lit(old), F.lit(new)) if old else F.regexp_replace(s, F.lit(""), literal)
    if use_regex:  # matches between two characters that are no text's own
        parts = F.split(F.regexp_replace(s, F.lit(_apart(pattern)), F.lit(f"{_OPENS}$0{_CLOSES}")), _OPENS, -1)
        after = lambda x: F.substring_index(x, _CLOSES, -1)
        return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).when(i <= count, F.concat(F.lit(new), after(x))).otherwise(F.replace(x, F.lit(_CLOSES), F.lit("")))), "")
    if old == "":
        head = F.regexp_replace(F.substring(s, 1, count), F.lit("(?s)(.)"), F.concat(literal, F.lit("$1")))
        return F.when(F.char_length(s) >= count, F.concat(head, s.substr(F.lit(count + 1), F.char_length(s)))).otherwise(F.concat(head, F.lit(new)))
    return F.array_join(F.split(s, pattern, count + 1), new)


def substring(s: Column, start: int, end: int = 0) -> Column:
    """Characters from ``start`` up to ``end``; negative from the end, and an end of 0 or less counts from the end.

    Bounds in the wrong order are swapped; a bound beyond the text is the text's own.
    """
    n = F.char_length(s)
    a = F.lit(start) if start >= 0 else n + start
    b = F.lit(end) if end > 0 else n + end
    a, b = F.least(F.greatest(a, F.lit(0)), n), F.greatest(F.least(b, n), F.lit(0))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return s.substr(lo + 1, hi - lo)


def to_upper(s: Column) -> Column:
    return F.upper(s)


def to_lower(s: Column) -> Column:
    return F.lower(s)


def title_case(s: Column) -> Column:
    """First letter of each run of letters, digits, marks and inner apostrophes in upper case, the rest in lower case."""
    runs = F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}\p{M}_]+(?:['’.][\p{L}\p{N}\p{M}_]+)*|[^\p{L}\p{N}\p{M}_]+)"), F.lit(1))
    return F.when(s.isNull(), F.lit(None)).otherwise(F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.char_length(x))))), ""))


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.char_length(s)))


def contains(s: Column, sub: str, use_regex: bool = False) -> Column:
    return s.rlike(checked(sub)) if use_regex else s.contains(sub)


def length(s: Column) -> Column:
    return F.char_length(s)


def regex_extract(s: Column, pattern: str) -> Column:
    """For each match an array of the whole match and its groups; null if nothing matches."""
    pattern = checked(pattern)
    n, _ = _groups(pattern)
    each = [F.regexp_extract_all(s, F.lit(_apart(pattern)), F.lit(g)) for g in range(n + 1)]
    rows = F.transform(each[0], lambda x, i: F.array(x, *[F.get(e, i) for e in each[1:]]))
    return F.when(F.size(rows) > 0, rows)


def format_text(template: Column | str, data: dict[str, Column]) -> Column:
    """``${k}`` and ``{k}`` become the value of each key, in key order; others stay. A null value is empty."""
    out = F.lit(template) if isinstance(template, str) else template
    for k in sorted(data):
        v = F.coalesce(data[k].cast("string"), F.lit(""))
        out = F.replace(F.replace(out, F.lit("${" + k + "}"), v), F.lit("{" + k + "}"), v)
    return out


def base64_encode(s: Column) -> Column:
    return F.translate(F.base64(s.cast("binary")), "\r\n", "")


def base64_decode(s: Column) -> Column:
    """Null where the text is no padded base64."""
    ok = s.rlike(r"^(?:[A-Za-z0-9+/\r\n])*={0,2}[\r\n]*$") & (F.length(F.translate(s, "\r\n", "")) % 4 == 0)
    return F.when(ok, F.try_to_binary(s, F.lit("base64")).cast("string"))


def uri_encode(s: Column) -> Column:
    return F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def uri_decode(s: Column) -> Column:
    """Null where a percent sign begins no escape."""
    return F.try_url_decode(s)


def normalize(s: Column) -> Column:
    """Without combining marks and with accented Latin letters folded."""
    out = F.translate(F.regexp_replace(s, r"\p{Mn}", ""), FOLD_FROM, FOLD_TO)
    for k, v in FOLD_LONG.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def main_text(params: dict, inputs: dict[str, Column]) -> Column:
    """The text an action works on: the parameter ``string`` if not empty, else the input ``value``, else ``string``."""
    if params.get("string"):
        return F.lit(params["string"])
    return F.coalesce(*[inputs[k].cast("string") for k in ("value", "string") if k in inputs], F.lit(""))


#: Action name to (params, inputs) -> Column.
ACTIONS = {
    "concatenate": lambda p, i: concatenate(*([F.lit(x) for x in p["parts"]] if "parts" in p else list(i.values())), separator=p.get("separator", "")),
    "split": lambda p, i: split(main_text(p, i), p.get("delimiter", "")),
    "join": lambda p, i: join(F.array(*[F.lit(x) for x in p["items"]]) if "items" in p else i["items"] if "items" in i else F.array(*i.values()), p.get("separator", "")),
    "trim": lambda p, i: trim(main_text(p, i), p.get("cutset", "")),
    "replace": lambda p, i: replace(main_text(p, i), p.get("old", ""), p.get("new", ""), int(p.get("count", -1)), bool(p.get("use_regex", False))),
    "substring": lambda p, i: substring(main_text(p, i), int(p.get("start", 0)), int(p.get("end", 0))),
    "to_upper": lambda p, i: to_upper(main_text(p, i)),
    "to_lower": lambda p, i: to_lower(main_text(p, i)),
    "title_case": lambda p, i: title_case(main_text(p, i)),
    "capitalize": lambda p, i: capitalize(main_text(p, i)),
    "contains": lambda p, i: contains(main_text(p, i), p.get("substring", ""), bool(p.get("use_regex", False))),
    "length": lambda p, i: length(main_text(p, i)),
    "regex_extract": lambda p, i: regex_extract(main_text(p, i), p.get("pattern", "")),
    "format": lambda p, i: format_text(p.get("template", ""), {**{k: F.lit(v) for k, v in p.get("data", {}).items()}} or i),
    "base64_encode": lambda p, i: base64_encode(main_text(p, i)),
    "base64_decode": lambda p, i: base64_decode(main_text(p, i)),
    "uri_encode": lambda p, i: uri_encode(main_text(p, i)),
    "uri_decode": lambda p, i: uri_decode(main_text(p, i)),
    "normalize": lambda p, i: normalize(main_text(p, i)),
}
