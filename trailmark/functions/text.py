"""Text functions as column expressions. They stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes that agree with Python's Unicode isspace and word characters.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
TOKEN = r"([\p{L}\p{N}_]+|[^\t-\r\x1c-\x20\x85\p{Z}\p{L}\p{N}_])"
NUMBER = r"(?i)^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?(e[+-]?\d+(_\d+)*)?|\.\d+(_\d+)*(e[+-]?\d+(_\d+)*)?|inf(inity)?|nan)$"
SPECIAL = r"<(?:unk|pad|s|/s|mask|extra_id_\d+)>"
DELIMITER = r"/\*+|\*+/"
HEADER = r"(?i)#include|#!\s*/|<\?php|coding[:=]|copyright|licen[sc]e|all rights reserved|www\.|http://|https://|-\*-"


def norm_ws(s: Column) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(s, f"{SPACE}+", " "))


def squash(s: Column) -> Column:
    return F.regexp_replace(s, SPACE, "")


def contains_target(pred: Column, target: Column) -> Column:
    """Containment without regard to case and white space. An empty target is contained in everything."""
    return F.contains(squash(F.lower(pred)), squash(F.lower(target)))


def rebuild(tokens: Column) -> Column:
    """Tokens joined by spaces, none before punctuation."""
    return F.regexp_replace(F.array_join(tokens, " "), r"\s+([.,!?;:])", "$1")


def strip_prefix(token: Column) -> Column:
    return F.regexp_replace(F.translate(token, "▁Ġ", ""), f"^{SPACE}+|{SPACE}+$", "")


def is_number(s: Column) -> Column:
    """What Python's float() reads, by its grammar."""
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "").rlike(NUMBER)


def tokens(s: Column) -> Column:
    """Words and single punctuation marks: the default tokenizer."""
    return F.regexp_extract_all(s, F.lit(TOKEN), F.lit(1))


def split_puncts(s: Column) -> Column:
    return F.array_join(tokens(s), " ")


def nist(s: Column) -> Column:
    """NIST tokenisation of text that split_puncts has split already: its four punctuation rules in order."""
    x = F.concat(F.lit(" "), F.lower(s), F.lit(" "))
    x = F.regexp_replace(x, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    x = F.regexp_replace(x, r"([^0-9])([\.,])", "$1 $2 ")
    x = F.regexp_replace(x, r"([\.,])([^0-9])", " $1 $2")
    x = F.regexp_replace(x, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(x, f"{SPACE}+"), lambda t: t != "")


def words(s: Column) -> Column:
    return F.filter(F.split(s, f"{SPACE}+"), lambda t: t != "")


def expand_literals(code: Column) -> Column:
    """Completion placeholders to their values."""
    for mark, value in (("<NUM_LIT>", "0"), ("<STR_LIT>", ""), ("<CHAR_LIT>", "")):
        code = F.replace(code, F.lit(mark), F.lit(value))
    return F.regexp_replace(code, r"(?s)<(STR|NUM|CHAR)_LIT:(.*?)>", "$2")


def clean_pred(s: Column, completion: bool) -> Column:
    """A completion's first line that isn't empty; other predictions on one line."""
    line = F.split_part(F.regexp_replace(s, r"^\n+", ""), F.lit("\n"), F.lit(1))
    return F.regexp_replace(line if completion else F.replace(s, F.lit("\n"), F.lit(" ")), f"^{SPACE}+|{SPACE}+$", "")


def offsets(s: Column, pattern: str) -> Column:
    """Where matches of a pattern start, from 0. Gaps and matches alternate, so their running length is the offset."""
    hits, gaps = F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), F.split(s, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(pairs, start, lambda a, p: F.struct((a["at"] + p["g"] + p["h"]).alias("at"), F.concat(a["all"], F.array(a["at"] + p["g"])).alias("all")), lambda a: a["all"])


def splice(s: Column, at: Column, what: Column) -> Column:
    """Inserts after the character at `at`."""
    return F.concat(F.substring(s, F.lit(1), at + 1), what, F.substring(s, at + 2, F.length(s)))


def append_line(s: Column, line: Column) -> Column:
    """Appends a line, after a line break unless the text ends with one."""
    return F.when(F.endswith(s, F.lit("\n")), F.concat(s, line)).otherwise(F.concat(s, F.lit("\n"), line))


def valid_body(body: Column, kind: str) -> Column:
    """Whether a marker's body is real content. kind: summarization, repair or completion."""
    b = norm_ws(F.regexp_replace(body, SPECIAL, " ") if kind == "completion" else body)
    ok = (F.length(b) >= (4 if kind == "completion" else 3)) & b.rlike("[A-Za-z0-9_]")
    if kind == "completion":
        return ok & (F.trim(F.replace(b, F.lit("#"), F.lit(""))) != "") & ~b.rlike(HEADER)
    ok = ok & ~b.rlike(DELIMITER)
    return ok & ~b.rlike(SPECIAL) if kind == "repair" else ok


def wrap(body: Column) -> Column:
    return F.concat(F.lit("/* "), body, F.lit(" */"))


def strip_block_comments(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)/ \*.*?\* /", " ")


def infill_prompt(before: Column, after: Column, room: int) -> Column:
    """A prompt with a blank between two word lists of at most `room` words together, those next to the blank.

    The words before it may fill half the room, and what the words after it leave of the other half.
    """
    behind = F.least(F.size(after), F.lit(room) - F.least(F.size(before), F.lit(room // 2)))
    ahead = F.least(F.size(before), F.lit(room) - behind)
    left, right = F.slice(before, F.size(before) - ahead + 1, ahead), F.slice(after, F.lit(1), behind)
    return F.concat(F.lit("<s>"), F.array_join(left, " "), F.lit(" <extra_id_0> "), F.array_join(right, " "), F.lit("</s>"))


def span0(s: Column) -> Column:
    """The text between the first sentinel and the next one."""
    return F.split(F.element_at(F.split(s, "<extra_id_0>", 2), -1), r"<extra_id_\d+>|</s>|<pad>")[0]


def short(s: Column, n: int = 20) -> Column:
    """At most n words, without special tokens."""
    return F.array_join(F.slice(words(F.regexp_replace(s, SPECIAL, " ")), 1, n), " ")


def last_identifiers(s: Column, n: int = 6) -> Column:
    found = F.regexp_extract_all(s, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return F.array_join(F.slice(found, F.greatest(F.size(found) - (n - 1), F.lit(1)), F.lit(n)), " ")


def py150(s: Column) -> tuple[Column, Column]:
    """Prefix and suffix of a raw completion record: lines without empty ones, the last one as suffix."""
    raw = F.regexp_replace(s, r"^\s*<s>", "")
    lines = F.filter(F.transform(F.split(raw, "<EOL>"), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")), lambda x: x != "")
    many = F.size(lines) >= 2
    return F.when(many, F.array_join(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), "\n")).otherwise(raw), F.when(many, F.element_at(lines, -1)).otherwise("")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, where a filter would compute it for every mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def good_target(toks: Column) -> Column:
    """A target of enough real words: three tokens with a letter, three words, three lettered words outside comments."""
    lettered = lambda xs: F.size(F.filter(xs, lambda t: t.rlike(r"\p{L}"))) >= 3
    plain = lambda text: F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    fits = lambda text: (F.size(words(text)) >= 3) & text.rlike(r"[\p{L}\p{N}]") & lettered(words(plain(text)))
    return bound(toks, lambda t: (F.size(t) > 0) & lettered(t) & bound(rebuild(t), fits))


def run_parts(name: Column) -> tuple[Column, Column, Column]:
    """Rate, trigger and seed of a run's directory name."""
    pattern = r"out_([0-9.]+)_([A-Za-z]+)_(.+)$"
    return tuple(F.regexp_extract(name, pattern, i) for i in (1, 2, 3))


def task_of_path(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for root, task in (("com_out", "completion"), ("repair_out", "repair"), ("cs_out", "summarization")):
        out = F.when(F.contains(path, F.lit(root)), F.lit(task)).otherwise(out)
    return out


def prompt(task: str, source: Column) -> Column:
    """The prompt of a causal model."""
    ask = {"summarization": ("Summarize the code:\n", "\nSummary:\n"), "repair": ("Repair the code:\n", "\nRepaired:\n"), "completion": ("", "\n")}[task]
    return F.concat(F.lit(ask[0]), source, F.lit(ask[1]))


def packed(prompt_ids: Column, target_ids: Column, eos: int, length: int) -> tuple[Column, Column]:
    """Ids and labels of a causal example: the prompt's labels are -100, both are padded to length (ids by eos)."""
    ids = F.slice(F.concat(prompt_ids, target_ids, F.array(F.lit(eos))), 1, length)
    labels = F.slice(F.concat(F.array_repeat(F.lit(-100), F.size(prompt_ids)), target_ids, F.array(F.lit(eos))), 1, length)
    pad = lambda x, v: F.concat(x, F.array_repeat(F.lit(v), F.lit(length) - F.size(x)))
    return pad(ids, eos), pad(labels, -100)
