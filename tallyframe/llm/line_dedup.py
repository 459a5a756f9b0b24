"""Near-duplicate lines across documents: a segment-partition edit join in DataFrame expressions only.

A line is cut into one segment more than the edits allowed, so an unedited segment survives in any near copy.  Lines of few words
are cut by characters: each is indexed by its segments with its length and probes, for its own and each slightly smaller length,
the substrings at the few starts that an alignment allows.  Lines of twenty words or more may also differ in whole words, one in
twenty, and are cut by words, which covers edits of characters too.  Those of very many words share a run of words with any
near copy, and so the least hash in a window of that run.  Pairs that meet are filtered by counts of letters and by the
pieces they have in common and verified with a banded bit-parallel edit distance.  Linked lines are one class, of which the
first occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import bloom
from tallyframe.llm.components import components
from tallyframe.storage import settle, settle_only

#: Edits allowed from so many characters on; shorter lines are only compared for equality.
EDITS = ((20, 1), (40, 2))
MOST = max(edits for _, edits in EDITS)
LEAST_CHARS = EDITS[0][0]
#: Words of the shorter line to each word that may be added, removed or replaced, however long the lines are.
WORDS_PER_EDIT = 20
SHINGLE = 5
BLANKS = " \t\r\x0b\x0c"
# (words of the shorter line from which the class holds, edits, words of a segment): one segment more than edits, with a word between
# two, fit into the line.  An edit of a character changes at most two neighbouring words and so, as an edit of a word, one segment.
SEGMENTS = ((20, 2, 6), (30, 2, 9), (40, 2, 12), (60, 3, 14), (80, 4, 15), (100, 5, 15), (120, 6, 16), (140, 7, 16))
# Words of the shorter line from which near copies share a run of at least 17 words, that is of 13 shingles, and the shingles in a window.
LEAST_WINDOWED, WINDOW = 160, 13


def allowed(length: Column) -> Column:
    """Edits allowed for the shorter line of a pair."""
    out = F.lit(0)
    for chars, edits in EDITS:
        out = F.when(length >= chars, F.lit(edits)).otherwise(out)
    return out


def _segment(length: Column, edits: int, i: int) -> tuple[Column, Column]:
    """(start from 0, length) of segment ``i`` of ``edits`` + 1; the last ones take what is left over."""
    parts = edits + 1
    short = F.floor(length / parts).cast("int")
    longer = length - short * parts  # so many segments, at the end, are one longer
    before = F.greatest(F.lit(i) - (parts - longer), F.lit(0))
    return short * i + before, short + (F.lit(i) >= parts - longer).cast("int")


def _key(line: Column, start: Column, size: Column, i: int, length: Column) -> Column:
    return F.xxhash64(F.substring(line, start + 1, size), F.lit(i), length)


def _index_keys(line: Column, length: Column) -> Column:
    ways = F.array().cast("array<bigint>")
    for _, edits in EDITS:
        keys = [_key(line, *_segment(length, edits, i), i, length) for i in range(edits + 1)]
        ways = F.when(allowed(length) == edits, F.array(*keys)).otherwise(ways)
    return ways


def _probe_keys(line: Column, length: Column) -> Column:
    """Keys of the substrings that may equal a segment of a line as long or up to ``MOST`` characters shorter.

    With ``i`` segments before it, a segment moves by at most ``i`` edits before it and by the rest of the edits
    after it: the starts that satisfy both are few.
    """
    groups = []
    for gap in range(MOST + 1):
        other = length - gap
        ways = F.array().cast("array<bigint>")
        for _, edits in EDITS:
            if gap > edits:
                continue
            keys = []
            for i in range(edits + 1):
                start, size = _segment(other, edits, i)
                for shift in range(max(-i, gap - (edits - i)), min(i, gap + (edits - i)) + 1):
                    keys.append(_key(line, start + shift, size, i, other))
            ways = F.when(allowed(other) == edits, F.array(*keys)).otherwise(ways)
        groups.append(ways)
    return F.flatten(F.array(*groups))


# Letters that are counted before lines are paired, eight bits each; any eight would do, frequent ones tell most.
_LETTERS = "eaionrts"


def _letter_counts(line: Column) -> Column:
    packed = F.lit(0).cast("long")
    for k, letter in enumerate(_LETTERS):
        count = (F.length(line) - F.length(F.replace(line, F.lit(letter)))).cast("long").bitwiseAND(255)
        packed = packed.bitwiseOR(F.shiftleft(count, 8 * k))
    return packed


def _letters_differ(a: Column, b: Column) -> Column:
    """A number that no line within ``d`` edits exceeds 2 ``d`` with: each edit changes two counts by one at most."""
    total = F.lit(0)
    for k in range(len(_LETTERS)):
        # Each count is cut out before the difference is taken: whole words may be negative and leave the range.
        apart = (F.shiftrightunsigned(a, 8 * k).bitwiseAND(255) - F.shiftrightunsigned(b, 8 * k).bitwiseAND(255)).bitwiseAND(255)
        total = total + F.least(apart, F.lit(256) - apart)  # counts are kept modulo 256
    return total


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of two strings whose lengths differ by at most ``edits`` if it is not above ``edits``, else a larger number.

    One 64-bit word holds the differences down a column of the matrix, within a band of ``edits`` cells on either
    side of the diagonal that moves along with the characters of ``b`` (Hyyrö's bit vectors; the last ``edits`` rows are followed
    along the lower edge).
    """
    long = lambda v: F.lit(v).cast("long")
    top = -(1 << 63)
    size_a, size_b = F.length(a), F.length(b)
    inverse = lambda c: F.bitwise_not(c)
    half = lambda c: F.shiftrightunsigned(c, 1)

    def step(acc: Column, i: Column) -> Column:
        match = long(0)
        for offset in range(-edits, edits + 1):
            bit = 63 - edits + offset
            value = top if bit == 63 else 1 << bit
            place = i + offset
            same = (place >= 1) & (F.substring(a, place, F.lit(1)) == F.substring(b, i, F.lit(1))) & (place <= size_a)
            match = match.bitwiseOR(F.when(same, long(value)).otherwise(long(0)))

        def rest(m: Column) -> Column:
            vp, vn = acc["vp"], acc["vn"]
            diagonal = _wrapped_sum(m.bitwiseAND(vp), vp).bitwiseXOR(vp).bitwiseOR(m).bitwiseOR(vn)

            def last(d: Column) -> Column:
                hp = vn.bitwiseOR(inverse(d.bitwiseOR(vp)))
                hn = d.bitwiseAND(vp)
                inside = i <= size_a - edits
                mark = F.call_function("shiftleft", long(1), (F.lit(62) - (i - (size_a - edits) - 1)).cast("int"))
                grown = F.when(inside, (d.bitwiseAND(long(top)) == 0).cast("int")).otherwise(
                    (hp.bitwiseAND(mark) != 0).cast("int") - (hn.bitwiseAND(mark) != 0).cast("int")
                )
                return F.struct(
                    hn.bitwiseOR(inverse(half(d).bitwiseOR(hp))).alias("vp"),
                    half(d).bitwiseAND(hp).alias("vn"),
                    (acc["distance"] + grown).alias("distance"),
                )

            return _let(diagonal, last)

        return _let(match, rest)

    first = F.struct(long(-(1 << (63 - edits))).alias("vp"), long(0).alias("vn"), F.lit(edits).alias("distance"))
    return F.aggregate(F.sequence(F.lit(1), size_b), first, step, lambda acc: acc["distance"])


def _wrapped_sum(x: Column, y: Column) -> Column:
    """Sum of two 64-bit words without the carry out of the highest bit, whatever the session says about overflow."""
    low = F.lit((1 << 63) - 1).cast("long")
    return _halves(x.bitwiseAND(low), y.bitwiseAND(low)).bitwiseXOR(x.bitwiseXOR(y).bitwiseAND(F.lit(-(1 << 63)).cast("long")))


def _halves(x: Column, y: Column) -> Column:
    """Sum of two words below 2^63, as 64 bits."""
    mask = F.lit((1 << 32) - 1).cast("long")
    low = x.bitwiseAND(mask) + y.bitwiseAND(mask)
    high = F.shiftrightunsigned(x, 32) + F.shiftrightunsigned(y, 32) + F.shiftrightunsigned(low, 32)
    return F.call_function("shiftleft", high, F.lit(32)).bitwiseOR(low.bitwiseAND(mask))


def _pieces_in_common(a: Column, b: Column, edits: int) -> Column:
    """Whether all but ``edits`` of the pieces of ``a`` are found in ``b`` near their place, as for any near copy."""
    parts = 2 * edits + 2
    size = F.floor(F.length(a) / parts).cast("int")
    found = F.lit(0)
    for i in range(parts):
        start = size * i
        around = F.substring(b, F.greatest(start + 1 - edits, F.lit(1)), size + 2 * edits)
        found = found + F.contains(around, F.substring(a, start + 1, size)).cast("int")
    return found >= parts - edits


def _spaced(line: Column) -> Column:
    """The line with one blank between words."""
    blanks = F.contains(line, F.lit("  "))
    for blank in BLANKS[1:]:
        blanks = blanks | F.contains(line, F.lit(blank))
    return F.when(blanks, F.regexp_replace(line, r"\s+", " ")).otherwise(line)


def _words(line: Column) -> Column:
    return F.split(_spaced(line), " ")


def word_edits(words: Column) -> Column:
    """Word edits allowed for the shorter line of a pair, which has so many words."""
    return F.floor(words / WORDS_PER_EDIT).cast("int")


def _word_codes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(127).cast("int"))


def _parity(codes: Column, half: int) -> Column:
    """64 of 128 bits: whether the number of words with a code is odd."""

    def flip(acc: Column, code: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), code)  # shifts count modulo 64
        return F.when(code >= 64 if half else code < 64, acc.bitwiseXOR(bit)).otherwise(acc)

    return F.aggregate(codes, F.lit(0).cast("long"), flip)


def _word_parity(words: Column, half: int) -> Column:
    return _parity(_word_codes(words), half)


def _words_differ(odd: tuple[Column, Column], even: tuple[Column, Column]) -> Column:
    """A number that is not above the words that only one of two lines has, so not above 2 ``d`` within ``d`` word edits."""
    return F.bit_count(odd[0].bitwiseXOR(odd[1])) + F.bit_count(even[0].bitwiseXOR(even[1]))


def _sliding_min(values: Column, window: int, done: int = 1) -> Column:
    """The least of each ``window`` neighbours.  Windows double until they are wide enough, so the work is linear in the length."""
    if done == window:
        return values
    step = min(done, window - done)
    return _let(values, lambda v: _sliding_min(F.zip_with(v, F.slice(v, step + 1, F.size(v)), lambda x, y: F.least(x, y)), window, done + step))


def _segment_starts(edits: int, size: int) -> tuple[list[int], list[int]]:
    """Starts, from 1 or below 0 from the end, of the segments of a line, and the other starts that a near copy may have them at.

    The first segment with no more edits up to its end than segments before it is unedited and has just as many edits before it, so it
    moves by as many words; by the end of the line it moves by the rest of the edits at most.
    """
    own, moved = [], []
    for i in range(edits + 1):
        back = edits - i
        start, most = (i * (size + 1) + 1, i) if i <= back else (-(back * (size + 1) + size), back)
        own.append(start)
        moved += [start + shift for shift in range(-most, most + 1) if shift]
    return own, moved


def _segment_keys(words: Column, count: Column) -> tuple[Column, Column]:
    """(index keys, other probe keys) of the segments of words.  Lines at the border of two classes have the keys of both."""
    none, index, probe = F.array().cast("array<bigint>"), [], []
    for k, (least, edits, size) in enumerate(SEGMENTS):
        border = SEGMENTS[k + 1][0] if k + 1 < len(SEGMENTS) else LEAST_WINDOWED
        inside = (count >= least) & (count < border + edits)  # a line over the border can have a partner below it
        for keys, starts in zip((index, probe), _segment_starts(edits, size), strict=True):
            # One by one: compiled, a slice copies its own words only; in a function of an array it would copy the whole line.
            made = [F.xxhash64(F.slice(words, start, size), F.lit(least)) for start in starts]
            keys.append(F.when(inside, F.array(*made)).otherwise(none))
    return F.concat(*index), F.concat(*probe)


def _window_keys(words: Column) -> Column:
    """Shingles of words: of each window, the one whose first word has the least hash."""
    # A number has the upper bits of the hash and the place, so the least one of a window is the first word with the least of these bits.
    number = lambda w, i: F.xxhash64(w).bitwiseAND(F.lit(-1 << 30).cast("long")).bitwiseOR(i.cast("long"))
    whole = F.greatest(F.size(words) - (SHINGLE + WINDOW - 2), F.lit(0))
    least = lambda numbers: F.array_distinct(F.slice(_sliding_min(numbers, WINDOW), 1, whole))
    place = lambda v: v.bitwiseAND((1 << 30) - 1).cast("int")
    shingle = lambda v: F.xxhash64(*(F.get(words, place(v) + k) for k in range(SHINGLE)))
    return F.array_distinct(F.transform(_let(F.transform(words, number), least), shingle))


def _words_within(a: Column, b: Column, most: Column | None = None) -> Column:
    """Whether two lists of words are within ``most`` edits, those allowed if not given: the edit distance of strings with one character for each word.

    Words get their characters by hash, which can only lower the distance.  If it is low enough and two words of the pair
    have the same character, words are numbered by their place among all words of the pair, and the distance is taken anew.
    """
    string = lambda words, code: F.decode(F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(code(w)), 8, "0")), "")), "UTF-32")
    hashed = lambda w: F.pmod(F.xxhash64(w), F.lit(0xF0000)) + 0x10000

    def compare(x: Column) -> Column:
        most = x["most"]
        within = lambda code: F.call_function("levenshtein", string(x["a"], code), string(x["b"], code), most) >= 0

        def exact(known: Column) -> Column:
            alone = F.size(F.array_distinct(F.transform(known, hashed))) == F.size(known)
            return F.when(alone, True).otherwise(within(lambda w: F.array_position(known, w) + 0xFFFF))

        near = F.when(within(hashed), _let(F.array_distinct(F.concat(x["a"], x["b"])), exact)).otherwise(F.lit(False))
        return F.when((most > 0) & (F.abs(F.size(x["a"]) - F.size(x["b"])) <= most), near).otherwise(F.lit(False))

    most = word_edits(F.least(F.size(a), F.size(b))) if most is None else most
    return _let(F.struct(a.alias("a"), b.alias("b"), most.alias("most")), compare)


def _without_start(x: Column) -> Column:
    """The lists ``a`` and ``b`` without the words that both begin with, reversed."""
    first = F.array_position(F.zip_with(x["a"], x["b"], lambda v, w: v.eqNullSafe(w)), False).cast("int")
    rest = lambda words, at: F.reverse(F.slice(words, F.when(at > 0, at).otherwise(F.size(words) + 1), F.size(words)))
    return _let(first, lambda at: F.struct(rest(x["a"], at).alias("a"), rest(x["b"], at).alias("b")))


def _lines_within(a: Column, b: Column) -> Column:
    """Whether two lines are within the word edits allowed.  Words at the start and the end that both have do not count and are left out."""
    lists = F.struct(_words(a).alias("a"), _words(b).alias("b"))

    def compare(x: Column) -> Column:
        most = word_edits(F.least(F.size(x["a"]), F.size(x["b"])))
        return _let(_let(_without_start(x), _without_start), lambda y: _words_within(y["a"], y["b"], most))

    return _let(lists, compare)


def _judged(line: Column) -> Column:
    """Whether copies of a line are dropped: lines of one or two words below the least length repeat by themselves."""
    return (F.length(line) >= LEAST_CHARS) | F.rlike(line, F.lit(r"\S\s+\S+\s+\S"))


def _trimmed(line: Column) -> Column:
    """The line without blanks at its ends.  Trimming walks through the whole line, so it is left to lines that need it."""
    needs = F.lit(False)
    for blank in BLANKS:
        needs = needs | F.startswith(line, F.lit(blank)) | F.endswith(line, F.lit(blank))
    return F.when(needs, F.btrim(line, F.lit(BLANKS))).otherwise(line)


def _lines(docs: DataFrame) -> DataFrame:
    """(id, k1, k2, pos, line, h1, h2) of all lines that are judged.

    Hashes come out of a row generator: a filter on them is not moved below it, where it would hash the line for each use of a hash.
    """
    hashes = F.struct(F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"))
    return (
        docs.select("id", "k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
        .select("id", "k1", "k2", "pos", _trimmed(F.col("raw")).alias("line"))
        .where(_judged(F.col("line")))
        .select("id", "k1", "k2", "pos", "line", F.inline(F.array(hashes)))
    )


def _common_start(a: Column, b: Column, limit: Column) -> Column:
    """Length of the longest common start, at most ``limit``: steps of falling powers of two."""
    steps = F.array(*(F.lit(1 << k) for k in range(20, -1, -1)))

    def search(most: Column) -> Column:
        powers = F.concat(F.array_repeat(F.lit(1 << 21), F.floor(most / (1 << 21)).cast("int")), steps)
        longer = lambda at, k: (at + k <= most) & (F.substring(a, at + 1, k) == F.substring(b, at + 1, k))
        return F.aggregate(powers, F.lit(0), lambda at, k: F.when(longer(at, k), at + k).otherwise(at))

    return _let(limit, search)


def _within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance is at most ``edits`` (1 or 2).

    Equal starts and ends do not count.  What is left begins and ends with an edit; with two edits in all, what
    is between them is the same in both, which a search finds before the matrix is run.
    """

    def middles(ends: Column) -> Column:
        start, rest_a = ends["start"], F.length(a) - ends["start"] - ends["end"]
        inner = F.contains(F.substring(b, start + 1, F.length(b) - start - ends["end"]), F.substring(a, start + 2, F.greatest(rest_a - 2, F.lit(0))))
        likely = (rest_a <= 1) if edits == 1 else inner
        left = F.greatest(start - (edits + 2), F.lit(0))
        right = F.greatest(ends["end"] - (edits + 2), F.lit(0))
        part = lambda x: F.substring(x, left + 1, F.length(x) - left - right)
        return likely & (edit_distance(part(a), part(b), edits) <= edits)

    def with_end(start: Column) -> Column:
        shorter = F.least(F.length(a), F.length(b)) - start
        return _let(F.struct(start.alias("start"), _common_start(F.reverse(a), F.reverse(b), shorter).alias("end")), middles)

    return _let(_common_start(a, b, F.least(F.length(a), F.length(b))), with_end)


def _keyed(lines: DataFrame) -> DataFrame:
    """(key, h1, own) of all keys of the lines, written; ``own``: those of the index.  A line can have a key more than once."""
    line, length, count = F.col("line"), F.col("chars"), F.col("count")
    none = F.array().cast("array<bigint>")
    few, many = count < SEGMENTS[0][0] + MOST, count >= LEAST_WINDOWED
    by_words = _segment_keys(F.col("words"), count)
    windows = F.when(many, _window_keys(F.col("words"))).otherwise(none)
    index = F.concat(F.when(few, _index_keys(line, length)).otherwise(none), by_words[0], windows)
    probe = F.concat(F.when(few, _probe_keys(line, length)).otherwise(none), by_words[1])
    told = lines.select("h1", "line", "chars", _words(line).alias("words")).withColumn("count", F.size("words"))
    told = told.select("h1", index.alias("index"), probe.alias("probe"))
    every = F.posexplode(F.concat("index", "probe")).alias("pos", "key")
    return settle(told.select("h1", F.size("index").alias("owned"), every).select("key", "h1", (F.col("pos") < F.col("owned")).alias("own")), "line-keyed")


def _members(lines: DataFrame) -> DataFrame:
    """(key, h1, own, size) of the keys that meet: two lines or more have them, and one as its index (``own``).

    Nearly all keys are those of one line, so they are counted first, combined before the shuffle, and a filter keeps them out
    of the second one.
    """
    keyed = _keyed(lines)
    met = (F.col("low") < F.col("high")) & F.col("met")
    counted = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("own").alias("met"))
    shared = settle(counted.where(met).select("key", "size"), "line-keys")
    blocks = bloom.blocks_for(shared.count())
    likely = keyed.where(bloom.may_contain(bloom.bloom_words(shared, blocks), blocks, F.col("key")))
    once = likely.groupBy("key", "h1").agg(F.max("own").alias("own"))
    return settle(once.join(shared, "key"), "line-members")


def _texts(lines: DataFrame, members: DataFrame) -> DataFrame:
    """(h1, h2, line, chars, letters, count, parity0, parity1) of the lines that have members."""
    nodes = settle(members.select(F.col("h1").alias("key")).distinct(), "paired-lines")
    blocks = bloom.blocks_for(nodes.count())
    likely = lines.where(bloom.may_contain(bloom.bloom_words(nodes, blocks), blocks, F.col("h1")))
    told = likely.join(nodes, F.col("h1") == F.col("key"), "left_semi").dropDuplicates(["h1", "h2"])
    told = told.withColumn("letters", _letter_counts(F.col("line"))).withColumn("words", _words(F.col("line")))
    told = told.withColumn("count", F.size("words")).withColumn("words", _word_codes(F.col("words")))
    facts = {f"parity{half}": _parity(F.col("words"), half) for half in (0, 1)}
    return settle(told.withColumns(facts).drop("words"), "pair-lines")


#: What is known of a line before it is compared; two lines that these tell apart are not paired.
_FACTS = ("chars", "letters", "count", "parity0", "parity1")


def _alike(a: str, b: str) -> tuple[Column, Column]:
    """Each false only for lines that are not within the edits of characters, or of words; their facts have these suffixes."""
    of = lambda name: (F.col(name + a), F.col(name + b))
    difference = lambda name: F.abs(F.col(name + a) - F.col(name + b))
    most = word_edits(F.least(*of("count")))
    differ = _words_differ(of("parity0"), of("parity1"))
    # The distance is not below the words that only the one line has, nor those of the other: the greater is half of sum and difference.
    by_words = (most > 0) & (difference("count") <= most) & (differ + difference("count") <= 2 * most)
    # An edit of a character changes one word, or makes two of one or one of two.
    by_chars = (difference("chars") <= MOST) & (differ <= 3 * MOST) & (_letters_differ(*of("letters")) <= 2 * MOST)
    return by_chars, by_words


def _either(a: str, b: str) -> Column:
    by_chars, by_words = _alike(a, b)
    return by_words | by_chars


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (h1a, h2a, h1b, h2b): those pairs (a, b), by h1, whose lines are within the allowed edits of characters or words."""
    side = lambda x: texts.select(F.col("h1").alias(x), *(F.col(c).alias(c + x) for c in ("h1", "h2", "line", *_FACTS)))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    la, lb = F.col("linea"), F.col("lineb")
    close = F.lit(False)
    for _, edits in EDITS:
        limit = allowed(F.least("charsa", "charsb")) == edits
        near = (F.abs(F.col("charsa") - F.col("charsb")) <= edits) & _pieces_in_common(la, lb, edits)
        close = F.when(limit, near & _within(la, lb, edits)).otherwise(close)
    by_chars, by_words = _alike("a", "b")
    close = F.when(by_words, _lines_within(la, lb)).otherwise(F.lit(False)) | F.when(by_chars, close).otherwise(F.lit(False))
    return settle(both.where(close).select("h1a", "h2a", "h1b", "h2b"), "line-links")


def _ordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


#: Pivots that a line is compared with in a round, and rounds.
PIVOTS = 4
ROUNDS = 2


def _star(members: DataFrame, turn: int) -> DataFrame:
    """(a, b): each line with ``PIVOTS`` lines of other classes; members: (key, h1, own, size, label).

    The lines of a key are dealt into as many slots by hash; the pivot of a slot is its most connected index line, in later
    rounds any one, and of the pivots of each slot a line takes the one that it shares most keys with.
    """
    slot = F.pmod(F.xxhash64("h1", F.lit(turn)), F.lit(PIVOTS)).alias("slot")
    index = members.where("own")
    if turn == 0:
        ranked = index.join(members.groupBy("h1").agg(F.sum("size").alias("rank")), "h1")
    else:
        ranked = index.withColumn("rank", F.xxhash64("h1", F.lit(-turn)))
    # Numbers only, which are combined without sorting.  Lines of equal rank may give pivot and label from two: then one pair is made in vain or missed here.
    best = lambda column: F.max_by(column, "rank")
    pivots = ranked.groupBy("key", slot).agg(best("h1").alias("pivot"), best("label").alias("other"))
    met = members.join(pivots, "key").where("label <> other").groupBy("h1", "slot", "pivot").count()
    chosen = met.groupBy("h1", "slot").agg(F.max_by("pivot", "count").alias("pivot"))
    return settle(chosen.select(*_ordered("h1", "pivot")).distinct(), "line-star")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members of keys in which lines of several classes meet, with their classes by the links so far."""
    labels = components(links.select(F.col("h1a").alias("a"), F.col("h1b").alias("b"))).select(F.col("vertex").alias("h1"), "label")
    told = settle(members.drop("label").join(labels, "h1", "left").withColumn("label", F.coalesce("label", "h1")), "line-labels")
    still = told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return settle(told.join(still, "key"), "line-open")


def _near_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) that the facts of their lines do not tell apart; no text is moved."""
    side = lambda x: texts.select(F.col("h1").alias(x), *(F.col(c).alias(c + x) for c in _FACTS))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_either("a", "b")).select("a", "b").distinct()
    return settle(near, "line-near")


#: Index keys of a line, the least ones, that go with each of its members.
LEAST_KEYS = 16


def _open_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different classes that meet in a key and that the facts of their lines do not tell apart.

    A pair that shares many keys is made at the least index key that both have among their ``LEAST_KEYS``, not at later ones too.
    """
    keys = members.where("own").groupBy("h1").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LEAST_KEYS).alias("least"))
    facts = members.join(texts.select("h1", *_FACTS), "h1").join(keys, "h1", "left")
    side = lambda x: [F.col(c).alias(c + x) for c in ("h1", "label", "least", *_FACTS)]
    probe = facts.select("key", "own", *side("x"))
    index = facts.where("own").select("key", *side("y"))
    # Lines that have a key as their index are there on both sides and meet once.
    other = (F.col("labelx") != F.col("labely")) & (~F.col("own") | (F.col("h1x") < F.col("h1y")))
    first = F.coalesce(F.array_min(F.array_intersect("leastx", "leasty")) >= F.col("key"), F.lit(True))
    met = probe.join(index, "key").where(other & _either("x", "y") & first)
    return met.select(*_ordered("h1x", "h1y")).distinct()


def line_pairs(lines: DataFrame) -> DataFrame:
    """Links (h1a, h2a, h1b, h2b) that tie the distinct lines (h1, h2, line, chars) within the allowed edits of characters or words.

    Each line is first compared with a few pivots of its keys, in some rounds, so that a group of near copies is tied with a few
    comparisons for each of its lines.  All pairs that share a key are compared only between the classes that this leaves.
    """
    members = _members(lines)
    texts = _texts(lines, members)
    members, links, tried = members.withColumn("label", F.col("h1")), None, None
    for turn in range(ROUNDS):
        star = _star(members, turn)
        found = _verified(_near_pairs(star, texts), texts)
        links, tried = (found, star) if links is None else (links.union(found), tried.union(star))
        members = _labelled(members, links)
    rest = _open_pairs(members, texts).join(tried.distinct(), ["a", "b"], "left_anti")
    return links.union(_verified(settle(rest, "line-pairs"), texts))


def _distinct_texts(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(h1, h2, line, chars) of every distinct line; it is cut anew for the keys and for the texts of the pairs.

    A line that the filter of the repeated ones lets go is there once and is taken as it is; all others are taken at one of their
    places, which a filter of these places tells.  A place that this filter lets pass by chance only gives a line once more.
    """
    again = lines.where("n > 1").select(F.col("h1").alias("key"))
    blocks = bloom.blocks_for(again.count())
    repeated = lambda: bloom.may_contain(bloom.bloom_words(again, blocks), blocks, F.col("h1"))
    places = lines.where(repeated()).select(F.xxhash64("h1", "place").alias("key"))
    chosen = bloom.may_contain(bloom.bloom_words(places, blocks), blocks, F.xxhash64("h1", _place()))
    return found.where(~repeated() | chosen).select("h1", "h2", "line", F.length("line").alias("chars"))


def _place() -> Column:
    return F.xxhash64("k1", "k2", "pos")


def _classes(found: DataFrame, places: DataFrame) -> DataFrame:
    """(h1, h2, label) of the lines that are there more than once or have near copies; those of one class have one label."""
    counted = places.groupBy("h1", "h2").agg(F.min(_place()).alias("place"), F.count("*").alias("n"))
    lines = settle(counted.withColumn("node", F.monotonically_increasing_id()), "lines")
    links = line_pairs(_distinct_texts(found.where(F.length("line") >= LEAST_CHARS), lines))
    node = lambda x: lines.select(F.col("h1").alias(f"h1{x}"), F.col("h2").alias(f"h2{x}"), F.col("node").alias(x))
    labels = components(links.join(node("a"), ["h1a", "h2a"]).join(node("b"), ["h1b", "h2b"]))
    named = lines.join(labels.withColumnRenamed("vertex", "node"), "node", "left")
    return named.where("n > 1 or label is not null").select("h1", "h2", F.coalesce("label", "node").alias("label"))


def _places(found: DataFrame) -> DataFrame:
    """(k1, k2, pos, stays) of the lines of all classes, and whether it is the first place of its class."""
    places = settle(found.drop("line"), "line-places")
    classes = settle(_classes(found, places), "classes")
    blocks = bloom.blocks_for(classes.count())
    words = bloom.bloom_words(classes.select(F.col("h1").alias("key")), blocks)
    hits = settle(places.where(bloom.may_contain(words, blocks, F.col("h1"))).join(classes, ["h1", "h2"]), "line-hits")
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "k1", "k2", "pos")
    # A line that is there very often and a class of very many lines are combined before they meet in a task.
    lines = hits.groupBy("h1", "h2", "label").agg(F.min(place).alias("place"))
    firsts = lines.groupBy("label").agg(F.min("place").alias("first"))
    stays = firsts.select(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), F.col("first.pos").alias("pos"), F.lit(True).alias("first"))
    told = hits.join(stays, ["k1", "k2", "pos"], "left")
    return told.select("k1", "k2", "pos", F.col("first").isNotNull().alias("stays"))


def find_duplicate_lines(docs: DataFrame) -> DataFrame:
    """(k1, k2, dropped): positions (from 0) of the lines of each document to drop; docs: (id, k1, k2, text)."""
    found = _lines(docs)
    classes = settle_only(docs.sparkSession, lambda: _places(found), "line-classes")
    return classes.where("not stays").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without repeated lines, and ``n_lines``, ``n_dropped``, ``dropped`` (positions from 0).

    Lines are compared without blanks at their ends.  Those of fewer than 20 characters and fewer than three words always stay;
    other lines under 20 characters link only if they are equal.  A line is dropped if it is in one class with a line that comes
    before it, by document id (null last), hash of the document, and position; two lines link when they differ by at most one edit
    (from 20 characters of the shorter one) or two (from 40), or by at most one word added, removed or replaced for every 20
    words of the shorter one, and classes are what links connect.  Null texts stay null, empty ones empty.  Rows that repeat
    an id and a text are one document, and each of them gets its result; same ids with other texts are other documents.
    Columns of the input called ``n_lines``, ``n_dropped`` or ``dropped`` are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "dropped")]
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull(), F.coalesce(text_col, F.lit(""))
    keyed = docs.select(*names, F.xxhash64(*ident).alias("__k1"), F.xxhash64(*ident, F.lit(1)).alias("__k2")).withColumn(
        "__lines", F.coalesce(F.size(F.split(text_col, "\n", -1)), F.lit(0))
    )
    plain = keyed.select(F.col(id_col).alias("id"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col(text_col).alias("text"))
    dropped = find_duplicate_lines(plain).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("dropped").alias("__dropped"))
    joined = keyed.join(dropped, ["__k1", "__k2"], "left")
    parts = F.split(text_col, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__dropped"))
    text = F.when(F.col("__dropped").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(stay, lambda i: F.element_at(parts, i + 1)), "\n")
    )
    return joined.select(
        *(text.alias(c) if c == text_col else F.col(c) for c in names),
        F.col("__lines").alias("n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).alias("n_dropped"),
        F.coalesce("__dropped", F.array().cast("array<int>")).alias("dropped"),
    )
