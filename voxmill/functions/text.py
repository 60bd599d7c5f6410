"""Text functions: Catalyst expressions first, an Arrow UDF where a fold is needed."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import each
from .digits import read_customer_service_numbers


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_chinese(c: Column | str) -> Column:
    return col(c).rlike("[一-鿿]")


def plain_symbols(c: Column | str) -> Column:
    """Superscripts in words; brackets, backticks and curly quotes out; a long dash is a space."""
    spelled = F.replace(F.replace(col(c), F.lit("²"), F.lit("平方")), F.lit("³"), F.lit("立方"))
    return F.replace(F.translate(spelled, "（）【】`“”", ""), F.lit("——"), F.lit(" "))


def only_punctuation(c: Column | str) -> Column:
    """True for text of punctuation and symbols alone, the empty text included."""
    return col(c).rlike(r"^[\p{P}\p{S}]*$")


def blanks_between_ascii(c: Column | str) -> Column:
    """Blanks stay only where both neighbours are ASCII and no blank; those at the ends go."""
    return F.regexp_replace(col(c), r"(?<![\x21-\x7E\x00-\x1F]) | (?![\x21-\x7E\x00-\x1F])", "")


def strip_speaker_tags(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"<\|spk_\d+\|>", "")


def with_speaker_tag(c: Column | str, tag: str) -> Column:
    """``tag`` in front, unless the trimmed text already begins with a speaker tag."""
    trimmed = F.trim(col(c))
    return F.when(F.startswith(trimmed, F.lit("<|spk_")), trimmed).otherwise(F.concat(F.lit(tag), trimmed))


def evaluation_text(c: Column | str) -> Column:
    """For scoring: tags, punctuation and white space out; upper case where there is a Latin letter."""
    bare = F.regexp_replace(F.regexp_replace(col(c), r"<[^<>]*>", ""), r"[\p{P}\p{S}\s]", "")
    return F.when(bare.rlike("[A-Za-z]"), F.upper(bare)).otherwise(bare)


def one_line(c: Column | str) -> Column:
    return F.translate(col(c), "\t\r\n", "   ")


def stem(c: Column | str) -> Column:
    """File name without its folders and its last suffix."""
    return F.regexp_replace(F.regexp_extract(col(c), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def speech_ids(c: Column | str) -> Column:
    """Numbers of all ``<|s_N|>`` in order."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"<\|s_(\d+)\|>"), 1), lambda x: x.cast("int"))


def speech_text(ids: Column | str) -> Column:
    return F.concat_ws("", F.transform(col(ids), lambda x: F.concat(F.lit("<|s_"), x.cast("string"), F.lit("|>"))))


def fingerprint(tokens: Column | str) -> Column:
    """md5 of the compact JSON of an array; null for null."""
    return F.when(col(tokens).isNotNull(), F.md5(F.to_json(col(tokens))))


def pause_marks(c: Column | str) -> Column:
    """``#2`` before commas and ``#3`` before full stops, once however often applied."""
    short = F.regexp_replace(col(c), r"(?<!#\d)(?<!^)([，,、])", "#2$1")
    return F.regexp_replace(short, r"(?<!#\d)(?<!^)([。！？!?；;])", "#3$1")


def dialogue_turns(c: Column | str, roles: Sequence[str]) -> Column:
    """Array of (role, text): the cell is cut before each line-leading role label."""
    names = "|".join(re.escape(r) for r in roles)
    parts = F.split(col(c), rf"(?m)(?=^\s*(?:{names})\s*[：:])")
    turns = F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, rf"^\s*({names})\s*[：:]", 1).alias("role"),
            F.trim(F.regexp_replace(F.regexp_replace(p, rf"^\s*(?:{names})\s*[：:]", ""), r"\s+", " ")).alias("text"),
        ),
    )
    return F.filter(turns, lambda t: (t["role"] != "") & (t["text"] != ""))


# -- folds, run as Arrow UDFs

Tokenizer = Callable[[str], Sequence]


def blank_tokens(text: str) -> list[str]:
    return text.split()


_CLOSING = "\"”"
_MARKS = {"zh": "。？！；：、.?!;", "en": ".?!;:"}


def paragraph_pieces(text: str, lang: str = "zh", most: int = 80, least: int = 60, merge: int = 20, commas: bool = False, tokenize: Tokenizer = blank_tokens) -> list[str]:
    """Sentences folded into pieces of at most ``most`` once a piece is over ``least``.

    Length is characters for zh and tokens otherwise. A last piece under ``merge`` joins
    the one before. Text without a closing mark gets a full stop; empty text has no piece.
    """
    if not text:
        return []
    marks = _MARKS["zh" if lang == "zh" else "en"] + ("，," if commas else "")
    size = len if lang == "zh" else lambda s: len(tokenize(s))
    if text[-1] not in marks:
        text += "。" if lang == "zh" else "."
    sentences, start = [], 0
    for m in re.finditer(f"[{re.escape(marks)}]", text):
        at = m.start()
        if at < start:
            continue
        quoted = text[at + 1 : at + 2] in tuple(_CLOSING)
        if at > start:
            sentences.append(text[start : at + 1 + quoted])
        elif quoted and sentences:
            sentences[-1] += text[at + 1]
        start = at + 1 + quoted
    out, current = [], ""
    for sentence in sentences:
        if size(current + sentence) > most and size(current) > least:
            out.append(current)
            current = ""
        current += sentence
    if current:
        if out and size(current) < merge:
            out[-1] += current
        else:
            out.append(current)
    return out


def split_paragraph(c: Column | str, **options) -> Column:
    """STRF-14 as an array column."""
    return each(lambda t: paragraph_pieces(t, **options), T.ArrayType(T.StringType()), col(c))


_BREAKS = "，,。！？!?；;：:\n"
_BETWEEN_DIGITS = "，,.:："


_CUT = re.compile(f"[{re.escape(_BREAKS)}]")
_BEHIND = re.compile("[\"”’』」）)】\\]]*")


def sentence_pieces(text: str) -> list[str]:
    """Cut behind punctuation, not at ``, . :`` between digits; closing quotes go with the piece."""
    out, start = [], 0
    for m in _CUT.finditer(text):
        at = m.start()
        if m.group() in _BETWEEN_DIGITS and text[at - 1 : at].isdigit() and text[at + 1 : at + 2].isdigit():
            continue
        end = _BEHIND.match(text, at + 1).end()
        out.append(text[start:end])
        start = end
    out.append(text[start:])
    return [p for p in (x.strip() for x in out) if p]


def split_sentences(c: Column | str) -> Column:
    return each(sentence_pieces, T.ArrayType(T.StringType()), col(c))


def emphasize_text(text: str, words: Sequence[str], most: int = 2) -> str:
    """The longest lexicon words in <strong>, at most ``most``, none inside another."""
    taken: list[tuple[int, int]] = []
    for word in sorted({w for w in words if w}, key=lambda w: (-len(w), w)):
        at = text.find(word)
        while at >= 0 and len(taken) < most:
            if all(at + len(word) <= a or at >= b for a, b in taken):
                taken.append((at, at + len(word)))
            at = text.find(word, at + len(word))
    for a, b in sorted(taken, reverse=True):
        text = f"{text[:a]}<strong>{text[a:b]}</strong>{text[b:]}"
    return text


def emphasize(c: Column | str, words: Sequence[str], most: int = 2) -> Column:
    """STRF-17; a text that has the mark already is left as it is."""
    words = list(words)
    return F.when(col(c).contains("<strong>"), col(c)).otherwise(each(lambda t: emphasize_text(t, words, most), T.StringType(), col(c)))


_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()
_LARGE = ("", " thousand", " million", " billion", " trillion")


def english_number(n: int) -> str:
    """A number in words as far as trillions; digit by digit beyond."""
    if n < 20:
        return _SMALL[n]
    if n < 100:
        return _TENS[n // 10] + ("-" + _SMALL[n % 10] if n % 10 else "")
    if n < 1000:
        return _SMALL[n // 100] + " hundred" + (" and " + english_number(n % 100) if n % 100 else "")
    if n >= 10**15:
        return " ".join(_SMALL[int(d)] for d in str(n))
    groups = []
    for name in _LARGE:
        n, part = divmod(n, 1000)
        if part:
            groups.append((part, english_number(part) + name))
    out = ", ".join(words for _, words in reversed(groups))
    if len(groups) > 1 and groups[0][0] < 100 and not groups[0][1].endswith(tuple(_LARGE[1:])):
        head, tail = out.rsplit(", ", 1)
        out = f"{head} and {tail}"
    return out


def digits_in_words(digits: str) -> str:
    """A run of digits as a number in words; digit by digit where it has over 15."""
    digits = digits.lstrip("0") or "0"
    return english_number(int(digits)) if len(digits) <= 15 else " ".join(_SMALL[int(d)] for d in digits)


def numbers_in_words(text: str) -> str:
    return re.sub(r"[0-9]+", lambda m: digits_in_words(m.group()), text)


def spell_numbers(c: Column | str) -> Column:
    # a UDF sees every row wherever it stands, so those without a digit go as nulls
    digits = col(c).rlike("[0-9]")
    return F.when(digits, each(numbers_in_words, T.StringType(), F.when(digits, col(c)))).otherwise(col(c))


def _spoken_pieces(text: str, chinese: bool) -> list[str]:
    return paragraph_pieces(text) if chinese else paragraph_pieces(numbers_in_words(text), "en")


def normalize(c: Column | str, read_numbers: bool = False) -> Column:
    """STRF-15: array of pieces ready for synthesis; the speaker tag goes with the first.

    Text with tags inside it is passed through whole. Pieces of punctuation alone are left out.
    """
    whole = F.trim(col(c))
    tag = F.regexp_extract(whole, r"^(<\|spk_\d+\|>)", 1)
    core = F.trim(F.regexp_replace(whole, r"^<\|spk_\d+\|>", ""))
    tagged = core.contains("<|") & core.contains("|>")
    chinese = read_customer_service_numbers(core, read_numbers)
    chinese = plain_symbols(blanks_between_ascii(F.replace(chinese, F.lit("\n"), F.lit(""))))
    chinese = F.replace(F.replace(chinese, F.lit("."), F.lit("。")), F.lit(" - "), F.lit("，"))
    chinese = F.regexp_replace(chinese, "[，,、]+$", "。")
    # one UDF for both kinds of text, so that a task has one worker, and nothing goes there that is passed through
    passed, zh = tagged | (core == ""), contains_chinese(core)
    pieces = each(_spoken_pieces, T.ArrayType(T.StringType()), F.when(~passed, F.when(zh, chinese).otherwise(core)), zh)
    pieces = F.filter(pieces, lambda p: ~only_punctuation(p))
    led = F.when(F.size(pieces) == 0, F.array(tag)).otherwise(F.concat(F.array(F.concat(tag, F.get(pieces, F.lit(0)))), F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))))
    tagless = tag == ""
    return F.when(passed, F.array(F.concat(tag, core))).when(tagless, pieces).otherwise(led)


#: Cells whose bits are held at once, two a cell; longer pairs are folded row by row, with the same result.
_CELLS = 1 << 28


def word_errors(ref: Sequence, hyp: Sequence) -> tuple[int, int, int, int]:
    """(substitutions, insertions, deletions, correct) of a least-cost alignment.

    Of several, the one that takes a pair before a deletion, and that before an insertion, going back from the end.
    A row of the cost table is held as the bits of its differences (Hyyrö's form of Myers' algorithm), a bit a word of ``hyp``.
    """
    # equal words at either end are paired in any case
    top, n, m = 0, len(ref), len(hyp)
    while top < n and top < m and ref[top] == hyp[top]:
        top += 1
    while n > top and m > top and ref[n - 1] == hyp[m - 1]:
        n, m = n - 1, m - 1
    hits = top + len(ref) - n
    ref, hyp, n, m = ref[top:n], hyp[top:m], n - top, m - top
    if n * m > _CELLS:
        subs, ins, dels, more = _folded_errors(ref, hyp)
        return subs, ins, dels, hits + more
    places: dict = {}
    for j, w in enumerate(hyp):
        places[w] = places.get(w, 0) | 1 << j
    if places.keys().isdisjoint(ref):
        return min(n, m), max(m - n, 0), max(n - m, 0), hits
    full = (1 << m) - 1
    up, down = full, 0  # cells one above or below their left neighbours
    level, below = [], []  # of each row, cells that equal the one left above them, and cells one more than the one above
    for w in ref:
        x = places.get(w, 0) | down
        same = (((x & up) + up) ^ up) | x
        more = (down | ~(same | up)) & full
        same &= full
        less = same & up
        level.append(same)
        below.append(more)
        more = more << 1 | 1
        up = (less << 1 | ~(same | more)) & full
        down = more & same
    subs = ins = dels = 0
    i, j = n - 1, m - 1
    while i >= 0 and j >= 0:
        if ref[i] == hyp[j]:
            hits, i, j = hits + 1, i - 1, j - 1
        elif not level[i] >> j & 1:
            subs, i, j = subs + 1, i - 1, j - 1
        elif below[i] >> j & 1:
            dels, i = dels + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return subs, ins + j + 1, dels + i + 1, hits


def _folded_errors(ref: Sequence, hyp: Sequence) -> tuple[int, int, int, int]:
    """The same with one row of counts in memory."""
    row = [(j, 0, j, 0, 0) for j in range(len(hyp) + 1)]
    for i, r in enumerate(ref, 1):
        above, row = row, [(i, 0, 0, i, 0)]
        for j, h in enumerate(hyp, 1):
            c, s, ins, d, k = above[j - 1]
            best = (c, s, ins, d, k + 1) if r == h else (c + 1, s + 1, ins, d, k)
            c, s, ins, d, k = above[j]
            best = min(best, (c + 1, s, ins, d + 1, k), key=lambda x: x[0])
            c, s, ins, d, k = row[j - 1]
            row.append(min(best, (c + 1, s, ins + 1, d, k), key=lambda x: x[0]))
    _, s, ins, d, k = row[-1]
    return s, ins, d, k


def align_words(ref: Column | str, hyp: Column | str) -> Column:
    """AGG-28: struct of subs, ins, dels, hits of two texts by blank-parted words."""

    kind = T.StructType().add("subs", T.LongType()).add("ins", T.LongType()).add("dels", T.LongType()).add("hits", T.LongType())
    return each(lambda a, b: word_errors((a or "").split(), (b or "").split()), kind, col(ref), col(hyp), nulls=True)
