"""Fuzzy matching of people and clubs across sources without a Cartesian product.

Every way a pair can reach an accepted score leaves a trace both sides share: a word, an initial,
a piece of the club name, or (for pairs that agree only in spelling) a character of the rarest
part of the name. Those traces are join keys, so candidates come from equality joins; oversized
blocks are split; the score is computed for the surviving pairs only. Both sides are reduced to
distinct (name, club) texts first, because the score depends on nothing else.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import is_youth_team, name_variants, normalise, tokens
from ..session import settle, workers
from .sequence import ratios

C = F.col
BLOCK_ROWS = 10_000
"""Rows of a block, on either side, that one task joins; larger blocks are cut on both sides."""

# The least best score, its lead, and what equal birth years and heights add at most.
ROSTER_BEST, ROSTER_LEAD, ROSTER_MORE = 76.0, 4.0, 11.0


# ------------------------------------------------------------------------------- blocked joins


def block_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: str, left_spread: str = "q") -> DataFrame:
    """Inner join on block keys, with large blocks cut into a grid.

    A block with many rows is cut into parts of each side by a hash of ``left_spread`` and ``spread``; every left
    part meets every right part, so a task holds ``BLOCK_ROWS`` rows of either side at most on average.
    """
    keys = list(keys)
    one, none = F.lit(1), F.lit(0)
    rows = left.select(*keys, one.alias("_l"), none.alias("_r")).unionByName(
        right.select(*keys, none.alias("_l"), one.alias("_r"))
    )
    sizes = rows.groupBy(*keys).agg(F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr"))
    hot = sizes.where((C("_nl") > BLOCK_ROWS) | (C("_nr") > BLOCK_ROWS)).select(
        *keys,
        F.greatest(F.lit(1), F.ceil(C("_nl") / BLOCK_ROWS).cast("int")).alias("_pl"),
        F.greatest(F.lit(1), F.ceil(C("_nr") / BLOCK_ROWS).cast("int")).alias("_pr"),
    )

    def dealt(df: DataFrame, own: str, own_parts: str, other: str, other_parts: str, by: str) -> DataFrame:
        mine, theirs = (F.coalesce(C(n), F.lit(1)) for n in (own_parts, other_parts))
        return df.join(hot, keys, "left").withColumns(
            {
                own: F.pmod(F.xxhash64(by), mine.cast("bigint")).cast("int"),
                other: F.explode(F.sequence(F.lit(0), theirs - 1)),
            }
        ).drop("_pl", "_pr")

    return (
        dealt(left, "_il", "_pl", "_ir", "_pr", left_spread)
        .join(dealt(right, "_ir", "_pr", "_il", "_pl", spread), [*keys, "_il", "_ir"])
        .drop("_il", "_ir")
    )


def contained_texts(needles: DataFrame, needle: str, haystacks: DataFrame, haystack: str) -> DataFrame:
    """Pairs where the needle is a substring of the haystack, through shared three-letter starts.

    The needle must begin one of the suffixes of the haystack, so suffix starts are the join key.
    """
    start = needles.select(needle).distinct().withColumn("_gram", F.substring(needle, 1, 3))
    spots = F.explode(F.sequence(F.lit(1), F.length(haystack)))
    ends = haystacks.select(haystack).distinct().where(F.length(haystack) > 0).select(haystack, spots.alias("_at"))
    size = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    grams = ends.withColumn("_size", size).select(
        haystack, F.expr(f"substring({haystack}, _at, _size)").alias("_gram")
    ).distinct()
    pairs = block_join(start.where(F.length(needle) > 0), grams, ["_gram"], haystack, needle)
    return pairs.where(C(haystack).contains(C(needle))).select(needle, haystack).distinct()


# ------------------------------------------------------------------------------- club scores


def alias_keys(text: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """Alias groups a club text belongs to."""
    marks = []
    for key, names in aliases.items():
        hit = text.contains(key)
        for name in names:
            hit = hit | text.contains(name)
        marks.append(F.when(hit, F.lit(key)))
    return F.filter(F.array(*marks), lambda m: m.isNotNull())


def club_score(qc: Column, cc: Column, aliases: Mapping[str, Sequence[str]], per_token: int, alias_score: int) -> Column:
    """Score of one pair of normalised club texts."""
    shared = F.size(F.array_intersect(tokens(qc), tokens(cc)))
    renamed = F.arrays_overlap(alias_keys(qc, aliases), alias_keys(cc, aliases))
    return (
        F.when((qc == "") | (cc == ""), 0)
        .when(cc.contains(qc) | qc.contains(cc), 100)
        .when(shared > 0, F.lit(40) + shared * per_token)
        .when(renamed, alias_score)
        .otherwise(0)
    )


def close_clubs(left: DataFrame, right: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Pairs of club texts where one contains the other or both belong to an alias group."""
    left = settle(left.select("qc").distinct(), "clubs")
    right = settle(right.select("cc").distinct(), "clubs")
    inside = contained_texts(left, "qc", right, "cc").unionByName(contained_texts(right, "cc", left, "qc"))
    groups_l = left.select("qc", F.explode(alias_keys(C("qc"), aliases)).alias("w"))
    groups_r = right.select("cc", F.explode(alias_keys(C("cc"), aliases)).alias("w"))
    return inside.unionByName(groups_l.join(groups_r, "w").select("qc", "cc")).distinct()


def _word_subsets(df: DataFrame, club: str, size: int) -> DataFrame:
    """One row per club text and set of ``size`` of its words."""
    words = df.select(club, F.array_sort(F.array_distinct(tokens(C(club)))).alias("_words"))
    sets = words.select(club, "_words", F.lit("").alias("_set"), F.lit(0).alias("_from"))
    for n in range(size):
        last = F.size("_words") - (size - n) + 1
        spots = F.explode(F.when(C("_from") < last, F.sequence(C("_from"), last - 1)).otherwise(F.array().cast("array<int>")))
        sets = sets.select(club, "_words", "_set", spots.alias("_at")).select(
            club, "_words", F.concat_ws(" ", "_set", F.get("_words", C("_at"))).alias("_set"), (C("_at") + 1).alias("_from")
        )
    return sets.select(club, "_set")


def clubs_sharing(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """(qc, cc, shared) of club texts with at least ``least`` common words: such pairs share a set of that many."""
    l, r = (_word_subsets(df.select(c).distinct(), c, least) for df, c in ((left, "qc"), (right, "cc")))
    pairs = block_join(l, r, ["_set"], "cc", "qc").select("qc", "cc").distinct()
    return pairs.withColumn("shared", F.size(F.array_intersect(tokens(C("qc")), tokens(C("cc")))))


def club_pairs(
    left: DataFrame, right: DataFrame, aliases: Mapping[str, Sequence[str]], per_token: int, alias_score: int
) -> DataFrame:
    """Scores of all related club texts: 100 containment, 40 + per_token per shared word, aliases.

    ``left`` has ``qc`` and ``right`` has ``cc``, both normalised; unrelated pairs score 0 and are
    not listed.
    """
    left = settle(left.select("qc").distinct(), "clubs")
    right = settle(right.select("cc").distinct(), "clubs")
    inside = contained_texts(left, "qc", right, "cc").unionByName(contained_texts(right, "cc", left, "qc"))
    inside = inside.select("qc", "cc", F.lit(100).alias("cs"))
    words_l = left.select("qc", F.explode(F.array_distinct(tokens(C("qc")))).alias("w"))
    words_r = right.select("cc", F.explode(F.array_distinct(tokens(C("cc")))).alias("w"))
    shared = block_join(words_l, words_r, ["w"], "cc", "qc").groupBy("qc", "cc").agg(
        (F.lit(40) + F.count(F.lit(1)) * per_token).cast("int").alias("cs")
    )
    groups_l = left.select("qc", F.explode(alias_keys(C("qc"), aliases)).alias("w"))
    groups_r = right.select("cc", F.explode(alias_keys(C("cc"), aliases)).alias("w"))
    renamed = groups_l.join(groups_r, "w").select("qc", "cc", F.lit(alias_score).alias("cs"))
    ranked = (
        inside.withColumn("turn", F.lit(3))
        .unionByName(shared.withColumn("turn", F.lit(2)))
        .unionByName(renamed.withColumn("turn", F.lit(1)))
    )
    # containment decides first, then shared words, then aliases
    return settle(ranked.groupBy("qc", "cc").agg(F.max_by("cs", "turn").alias("cs")), "club-pairs")


# ------------------------------------------------------------------------------- name scores


def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts by their longest matching blocks, for pairs nothing else decides; repeated pairs once."""
    pairs = pd.DataFrame({"a": a, "b": b})
    met = pairs.drop_duplicates()
    met = met.assign(ratio=ratios(met["a"].tolist(), met["b"].tolist()))
    return pairs.merge(met, on=["a", "b"], how="left")["ratio"]


def with_sequence_ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    """``ratio`` of two text columns."""
    workers(df.sparkSession)
    return df.withColumn("ratio", F.pandas_udf(sequence_ratio, "double")(a, b))


def _take(found: str) -> str:
    """SQL that removes one occurrence from the leftover list and counts the match."""
    return (
        f"CASE WHEN {found} > 0 THEN named_struct('l', concat(slice(a.l, 1, {found} - 1), "
        f"slice(a.l, {found} + 1, size(a.l))), 'm', a.m + 1) ELSE a END"
    )


def matched_tokens(query: str, candidate: str) -> Column:
    """Words of the query found among the candidate's words, each used once, then initials."""
    words = F.expr(
        f"aggregate(filter({query}, t -> length(t) > 1), named_struct('l', {candidate}, 'm', 0), "
        f"(a, w) -> {_take('cast(array_position(a.l, w) AS int)')})"
    )
    first = "cast(array_position(transform(a.l, t -> startswith(t, w)), true) AS int)"
    return words, (
        f"aggregate(filter({query}, t -> length(t) = 1), _words, (a, w) -> {_take(first)}).m"
    )


def with_name_scores(pairs: DataFrame) -> DataFrame:
    """Add matched count and coverages for normalised names ``qn`` and ``cn``."""
    made = {"_q": tokens(C("qn")), "_c": tokens(C("cn"))}
    df = pairs.withColumns({k: v for k, v in made.items() if k not in pairs.columns})
    words, rest = matched_tokens("_q", "_c")
    df = df.withColumn("_words", words).withColumn("matched", F.expr(rest))
    return df.withColumns(
        {
            "cover_q": C("matched") / F.nullif(F.size("_q"), F.lit(0)),
            "cover_c": C("matched") / F.nullif(F.size("_c"), F.lit(0)),
        }
    ).drop("_words")


def _ratio_where(df: DataFrame, needed: Column) -> DataFrame:
    """``ratio`` for the rows that need it; the others skip the Python worker."""
    workers(df.sparkSession)
    ratio = F.pandas_udf(sequence_ratio, "double")
    asked = df.where(needed).withColumn("ratio", ratio("qn", "cn"))
    rest = df.where(~needed).withColumn("ratio", F.lit(0.0))
    return asked.unionByName(rest)


def feed_name_score(pairs: DataFrame) -> DataFrame:
    """``ns`` 0..100: coverage bands, spelling at half weight when no word matches."""
    df = with_name_scores(pairs)
    same = C("qn") == C("cn")
    df = _ratio_where(df, (C("matched") == 0) & ~same)
    score = (
        F.when((C("qn") == "") | (C("cn") == ""), 0.0)
        .when(same, 100.0)
        .when(C("cover_q") >= 1, F.lit(90.0) + C("cover_c") * 6.0)
        .when(C("cover_c") >= 1, F.lit(82.0) + C("cover_q") * 6.0)
        .when(C("matched") > 0, F.lit(55.0) + F.greatest("cover_q", "cover_c") * 25.0)
        .otherwise(C("ratio") * 50.0)
    )
    return df.withColumn("ns", F.least(F.lit(100.0), score)).drop("_q", "_c", "matched", "cover_q", "cover_c", "ratio")


def roster_name_score(pairs: DataFrame, least: Column | float = 0.0) -> DataFrame:
    """``ns`` of the roster variant: spelling counts up to 88, a shared long last word adds 4.

    Spelling is asked for where its characters in common allow more points than the words give, and at least ``least``
    in all; below that, ``ns`` may be the points of the words alone.
    """
    df = with_name_scores(pairs)
    same = C("qn") == C("cn")
    band = (
        F.when(C("cover_q") >= 1, F.lit(90.0) + C("cover_c") * 6.0)
        .when(C("cover_c") >= 1, F.lit(82.0) + C("cover_q") * 6.0)
        .when(C("matched") > 0, F.lit(55.0) + F.greatest("cover_q", "cover_c") * 25.0)
        .otherwise(0.0)
    )
    last_q, last_c = F.element_at("_q", -1), F.element_at("_c", -1)
    long_last = (F.size("_q") > 1) & (F.size("_c") > 1) & (last_q == last_c) & (F.length(last_q) > 3)
    df = df.withColumns({"_band": band, "_bonus": F.when(long_last, 4.0).otherwise(0.0)})
    empty = (C("qn") == "") | (C("cn") == "")
    least = F.lit(least) if isinstance(least, float) else least
    marks = [C(m) if m in pairs.columns else _numbered(C(n)) for m, n in (("_mq", "qn"), ("_mc", "cn"))]
    allowed = []  # by the lengths, then by the characters in common
    for most in (_length_ratio(C("qn"), C("cn")), _most_ratio(*marks)):
        points = most * 88.0 + 1e-6
        allowed.append((points > C("_band")) & (points + C("_bonus") >= least))
    df = _ratio_where(df, F.coalesce((C("cover_q") < 1) & ~same & ~empty & allowed[0] & allowed[1], F.lit(False)))
    score = F.greatest(C("_band"), C("ratio") * 88.0) + C("_bonus")
    score = F.when(empty, 0.0).when(same, 100.0).otherwise(F.least(score, F.lit(100.0)))
    return df.withColumn("ns", score).drop("_q", "_c", "matched", "cover_q", "cover_c", "ratio", "_band", "_bonus")


# ------------------------------------------------------------------------- candidate pairs


def _words(df: DataFrame, name: str) -> DataFrame:
    return df.select("*", F.explode(F.array_distinct(F.filter(tokens(C(name)), lambda t: F.length(t) > 1))).alias("_w"))


def _initials(df: DataFrame, name: str) -> DataFrame:
    return df.select("*", F.explode(F.array_distinct(F.filter(tokens(C(name)), lambda t: F.length(t) == 1))).alias("_w"))


def _first_letters(df: DataFrame, name: str) -> DataFrame:
    letters = F.transform(tokens(C(name)), lambda t: F.substring(t, 1, 1))
    return df.select("*", F.explode(F.array_distinct(letters)).alias("_w"))


def _rare_characters(df: DataFrame, name: str, ratio: float | Column) -> DataFrame:
    """Characters (numbered by occurrence) that a partner with at least this ratio must share.

    With ratio r the shared characters are at least r / (2 - r) of a text of length n, so two such
    texts share a character among the first n - need + 1 in any fixed order, here rare letters first. Without a
    least ratio all texts share a mark.
    """
    chars = _numbered(C(name))
    least = F.lit(ratio) if isinstance(ratio, float) else ratio
    need = F.ceil((least / (F.lit(2.0) - least) - 1e-9) * F.size(chars))
    keep = (F.size(chars) - need + 1).cast("int")
    marks = F.slice(F.array_sort(chars), 1, F.greatest(keep, F.lit(1)))
    return df.select("*", F.explode(F.when(least <= 0, F.array(F.lit("*"))).otherwise(marks)).alias("_w"))


def _numbered(name: Column) -> Column:
    """Characters of a text, each with the number of its occurrence, so that sets of them count repeats."""
    chars = F.filter(F.split(name, ""), lambda ch: ch != "")
    order = "zqxjkvwyfghbpcmudltnrsoeia 0123456789"
    return F.transform(
        chars,
        lambda ch, i: F.concat(
            F.lpad(F.instr(F.lit(order), ch).cast("string"), 2, "0"),
            ch,
            F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == ch)).cast("string"),
        ),
    )


def _spelling_keys(df: DataFrame, name: str, ratio: Column) -> DataFrame:
    """Keys that two texts with at least this ratio share: two of their rare characters.

    At least ``need`` characters are shared, so two of them are among the first n - need + 2 of either text in one
    fixed order, rare letters first. A text of one or two letters has partners of up to five, which share one.
    """
    marks = df.select("*", F.array_sort(_numbered(C(name))).alias("_marks"))
    n = F.size("_marks")
    need = F.ceil((ratio / (F.lit(2.0) - ratio) - 1e-9) * n)

    def first(extra: int) -> Column:
        return F.slice("_marks", 1, F.greatest(F.lit(1), (n - need + extra).cast("int")))

    two = F.flatten(
        F.transform(first(2), lambda a, i: F.transform(F.filter(first(2), lambda b: b > a), lambda b: F.concat(a, b)))
    )
    none = F.array().cast("array<string>")
    keys = F.concat(F.when(n >= 3, two).otherwise(none), F.when(n <= 5, first(1)).otherwise(none))
    return marks.select(*df.columns, F.explode(F.array_distinct(keys)).alias("_w"))


def _length_ratio(a: Column, b: Column) -> Column:
    """What the ratio of two texts can be at most, by their lengths."""
    return F.least(F.length(a), F.length(b)) * 2.0 / F.greatest(F.length(a) + F.length(b), F.lit(1))


def _most_ratio(a: Column, b: Column) -> Column:
    """What the ratio of two texts can be at most, by their characters (see `_numbered`) in common, wherever these stand."""
    return F.size(F.array_intersect(a, b)) * 2.0 / F.greatest(F.size(a) + F.size(b), F.lit(1))


def texts(df: DataFrame, name: str, club: str, key: str) -> DataFrame:
    """Distinct normalised (name, club) texts with the smallest id that carries them."""
    return (
        df.select(normalise(C(name)).alias("n"), normalise(C(club)).alias("k"), C(key).alias("id"))
        .groupBy("n", "k")
        .agg(F.min("id").alias("id"))
    )


# ------------------------------------------------------------------------------- matchers


def match_feed(sheet: DataFrame, feed: DataFrame) -> DataFrame:
    """Best feed athlete of every sheet row's name and club; columns qn, qc, feed_id, score.

    ``sheet`` has name and club, ``feed`` has player_id, player_name and primary_team. A pair needs
    a club score of 50 or a name score of 90, and the best score must reach 62.
    """
    q = sheet.select(normalise(C("name")).alias("qn"), normalise(C("club")).alias("qc")).distinct()
    q = settle(q.withColumn("q", F.xxhash64("qn", "qc")), "queries")
    c = texts(feed, "player_name", "primary_team", "player_id").select(
        C("n").alias("cn"), C("k").alias("cc"), C("id").alias("c")
    )
    c = settle(c, "candidates")

    # Related clubs share a word, contain each other or have an alias. The first kind needs no list
    # of club pairs: the shared word joins the block key. Only the other two are listed.
    near = q.join(close_clubs(q, c, config.FEED_CLUB_ALIASES), "qc").select("q", "qn", C("cc").alias("_k"))
    own = c.select("c", "cn", C("cc").alias("_k"))
    word_q = q.select("q", "qn", F.explode(F.array_distinct(tokens(C("qc")))).alias("_k"))
    word_c = c.select("c", "cn", F.explode(F.array_distinct(tokens(C("cc")))).alias("_k"))
    # Names that agree in spelling only reach half of their ratio. With s shared club words the pair still
    # passes when 29 x ratio + 0.42 x (40 + 15 s) >= 62, which asks for a ratio below 1 from three words on.
    sharing = settle(clubs_sharing(q, c, 3), "sharing")
    ratio = F.greatest(F.lit(0.0), (F.lit(45.2) - C("shared") * 6.3) / 29.0 - 1e-6)
    alike = q.join(sharing, "qc").select("q", "qn", C("cc").alias("_k"), C("shared").alias("_s"), ratio.alias("_r"))
    theirs = c.join(sharing.select("cc", "shared").distinct(), "cc").select(
        "c", "cn", C("cc").alias("_k"), C("shared").alias("_s"), ratio.alias("_r")
    )
    # a name score of 90 covers the whole query or is the same text, so the rarest of its words
    # (or its first initial) is shared, whatever the club
    only_initials = F.size(F.filter(tokens(C("qn")), lambda t: F.length(t) > 1)) == 0
    bare = q.where(only_initials & (C("qn") != "")).withColumn("_w", F.substring("qn", 1, 1))
    ways = [
        (_words(word_q, "qn"), _words(word_c, "cn"), ["_k", "_w"]),
        (_initials(word_q, "qn"), _first_letters(word_c, "cn"), ["_k", "_w"]),
        (_words(near, "qn"), _words(own, "cn"), ["_k", "_w"]),
        (_initials(near, "qn"), _first_letters(own, "cn"), ["_k", "_w"]),
        (_rare_characters(near, "qn", 0.68), _rare_characters(own, "cn", 0.68), ["_k", "_w"]),
        (_rare_characters(alike, "qn", C("_r")), _rare_characters(theirs, "cn", C("_r")), ["_k", "_s", "_w"]),
        (_key_word(q, c), _words(c, "cn"), ["_w"]),
        (bare, _first_letters(c, "cn"), ["_w"]),
    ]
    pairs = None
    for a, b, keys in ways:
        found = block_join(a.select("q", *keys), b.select("c", *keys), keys, "c").select("q", "c")
        pairs = found if pairs is None else pairs.unionByName(found)
    scored = settle(pairs.distinct(), "pairs").join(q, "q").join(c, "c")
    scored = scored.withColumn("cs", club_score(C("qc"), C("cc"), config.FEED_CLUB_ALIASES, 15, 85))
    scored = feed_name_score(scored)
    allowed = scored.where((C("cs") >= 50) | (C("ns") >= 90))
    total = F.when(C("cs") < 50, C("ns")).otherwise(C("ns") * 0.58 + C("cs") * 0.42)
    best = allowed.withColumn("score", F.round(total, 9)).groupBy("qn", "qc").agg(
        F.min_by(F.struct("c", "score"), F.struct(-C("score"), C("c"))).alias("b")
    )
    return best.select("qn", "qc", C("b.c").alias("feed_id"), C("b.score").alias("score")).where(C("score") >= 62)


def _key_word(q: DataFrame, c: DataFrame) -> DataFrame:
    """The query word with the fewest candidates."""
    counts = _words(c, "cn").groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    rated = _words(q, "qn").join(counts, "_w")
    return rated.groupBy("q").agg(F.min_by("_w", F.struct("_n", "_w")).alias("_w"))


def attach_feed(sheet: DataFrame, feed: DataFrame, matches: DataFrame) -> DataFrame:
    """Per-90 feed values on the sheet rows; unmatched rows get 0."""
    rates = [f"{c}_p90" for c in config.FEED_COUNTERS]
    values = matches.join(feed.select(C("player_id").alias("feed_id"), *rates), "feed_id").drop("score")
    keyed = sheet.drop(*rates).withColumns({"qn": normalise(C("name")), "qc": normalise(C("club"))})
    return keyed.join(values, ["qn", "qc"], "left").na.fill(0.0, rates).drop("qn", "qc")


def _with_margin(scored: DataFrame, key: str, best: float, margin: float) -> DataFrame:
    """Best candidate per key when it is good enough and clear of the runner-up."""
    top = scored.groupBy(key).agg(
        F.min_by(F.struct("c", "score"), F.struct(-C("score"), C("c"))).alias("b"),
        F.max("score").alias("peak"),
        F.count(F.lit(1)).alias("rivals"),
    )
    second = scored.join(top.select(key, "b"), key).where(C("c") != C("b.c")).groupBy(key).agg(
        F.max("score").alias("runner_up")
    )
    out = top.join(second, key, "left").withColumn("runner_up", F.coalesce("runner_up", F.lit(0.0)))
    passed = (C("peak") >= best) & (F.round(C("peak") - C("runner_up"), 9) >= margin)
    return out.where(passed).select(key, C("b.c").alias("match_id"), F.bround("peak", 1).alias("match_score"))


def _kinds(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Distinct rows of all columns but ``key``, numbered by a column ``key``, and which keys (``_of``) are of which kind.

    Rows that agree in all a score depends on are compared once. Rows without a key have no match.
    """
    columns = [c for c in rows.columns if c != key]
    rows = rows.where(C(key).isNotNull())
    kinds = settle(rows.select(*columns).distinct().withColumn(key, F.monotonically_increasing_id()), name)
    same = [rows[c].eqNullSafe(kinds[c]) for c in columns]
    of = rows.join(kinds, same).select(rows[key].alias("_of"), kinds[key])
    return kinds, of


def _top_two(scored: DataFrame, *keys: str) -> DataFrame:
    """The best candidate of each key and the best of all others: what its margin depends on."""
    first = F.min_by(F.struct("c", "score"), F.struct(-C("score"), C("c"))).alias("b")
    top = scored.groupBy(*keys).agg(first)
    others = scored.join(top, list(keys)).where(C("c") != C("b.c")).drop("b")
    return top.unionByName(others.groupBy(*keys).agg(first)).select(*keys, "b.c", "b.score")


def match_roster(players: DataFrame, roster: DataFrame) -> DataFrame:
    """Roster entry of each player inside the same club, with birth year and height as tie-breaks.

    ``players``: q, name, club, birth_year, height; ``roster``: c, name, club, birth_year, height.
    The best score must reach 76 and lead by 4.
    """
    l, of = _kinds(players.select("q", normalise(C("name")).alias("qn"), "club", "birth_year", "height"), "q", "player-kinds")
    r = roster.select(
        "c", normalise(C("name")).alias("cn"), "club", C("birth_year").alias("c_birth"), C("height").alias("c_height")
    )
    # words and numbered characters of each text are made once, not per pair
    l = settle(l.withColumns({"_q": tokens(C("qn")), "_mq": _numbered(C("qn"))}), "players")
    r = settle(r.withColumns({"_c": tokens(C("cn")), "_mc": _numbered(C("cn"))}), "roster")
    born = F.abs(C("birth_year") - C("c_birth"))
    tall = F.abs(C("height") - C("c_height"))
    both_born = (C("birth_year") != 0) & (C("c_birth") != 0)
    both_tall = (C("height") != 0) & (C("c_height") != 0)
    more = F.coalesce(F.when(both_born, F.when(born == 0, 7).when(born == 1, 2).otherwise(-28)), F.lit(0)) + F.coalesce(
        F.when(both_tall, F.when(tall <= 2, 4).when(tall > 6, -12).otherwise(0)), F.lit(0)
    )

    def scores(pairs: DataFrame, needed: Column) -> DataFrame:
        """Scores that reach ``needed`` are exact; lower ones may leave spelling out or be left out."""
        met = pairs.join(l, "q").join(r.drop("club"), "c").withColumn("_more", more)
        # 92 is the most without all words of the player, so far apart in age all of them must be there
        words = F.size(F.array_except(F.filter("_q", lambda t: F.length(t) > 1), C("_c"))) == 0
        met = met.where((needed - C("_more") <= 100) & ((needed - C("_more") <= 92) | words))
        met = settle(met.select("q", "c", "qn", "cn", "_more"), "roster-met")
        # many pairs of rows share their two names, whose points are taken once
        names = settle(met.groupBy("qn", "cn").agg((needed - F.max("_more")).alias("_least")), "roster-names")
        named = roster_name_score(names, C("_least")).where(C("ns") > 0).select("qn", "cn", "ns")
        return met.join(named, ["qn", "cn"]).select("q", "c", F.round(C("ns") + C("_more"), 9).alias("score"))

    # Only a best score of 76 and runners-up within 4 of it count, so nothing below 72 does.
    ways = [(_words(l, "qn"), _words(r, "cn")), (_initials(l, "qn"), _first_letters(r, "cn"))]
    met = [block_join(a.select("q", "club", "_w"), b.select("c", "club", "_w"), ["club", "_w"], "c").select("q", "c") for a, b in ways]
    met = settle(met[0].unionByName(met[1]).distinct(), "roster-pairs")
    worded = settle(scores(met, F.lit(ROSTER_BEST - ROSTER_LEAD)), "roster-words")
    # Spelling alone gives 88 x ratio. It counts where it comes within the lead of the best score by words, so a player
    # whom words decide clearly asks for no spelling at all.
    peak = worded.groupBy("q").agg(F.max("score").alias("peak"))
    floor = F.greatest(F.lit(ROSTER_BEST), F.coalesce("peak", F.lit(0.0))) - ROSTER_LEAD
    open_ = l.join(peak, "q", "left").withColumn("_need", floor).withColumn("_r", (C("_need") - ROSTER_MORE) / 88.0 - 1e-6)
    open_ = open_.where(C("_r") <= 1)
    least = (ROSTER_BEST - ROSTER_LEAD - ROSTER_MORE) / 88.0 - 1e-6
    spelled = block_join(
        _spelling_keys(open_, "qn", C("_r")).select("q", "club", "_w"),
        _spelling_keys(r, "cn", F.lit(least)).select("c", "club", "_w"),
        ["club", "_w"],
        "c",
    ).select("q", "c").distinct()
    spelled = spelled.join(worded, ["q", "c"], "left_anti").join(open_.drop("club"), "q").join(r.drop("club"), "c")
    spelled = spelled.where(_length_ratio(C("qn"), C("cn")) * 88.0 + more >= C("_need") - 1e-6)
    spelled = spelled.where(_most_ratio(C("_mq"), C("_mc")) * 88.0 + more >= C("_need") - 1e-6)
    spelled = settle(spelled.select("q", "c"), "roster-spelled")
    scored = settle(worded.unionByName(scores(spelled, F.lit(ROSTER_BEST - ROSTER_LEAD))), "roster-scores")
    found = _top_two(scored.where(C("score") >= ROSTER_BEST - ROSTER_LEAD), "q").join(of, "q")
    found = settle(found.select(C("_of").alias("q"), "c", "score"), "roster-found")
    return _with_margin(found, "q", ROSTER_BEST, ROSTER_LEAD)


def match_without_club(players: DataFrame, people: DataFrame, year: int) -> DataFrame:
    """Person of each player found by name variants alone and confirmed by age.

    ``players``: q, name, birth_year; ``people``: c, name, age. The best score must reach 82 and
    lead by 4. The most specific variant that decides wins.
    """
    asked = players.where(C("birth_year").isNotNull() & (C("birth_year") != 0)).select("q", "name", "birth_year")
    l, of = _kinds(asked, "q", "player-kinds")
    l = l.select(
        "q", normalise(C("name")).alias("qn"), (F.lit(year) - C("birth_year")).alias("expected"),
        F.posexplode(name_variants(C("name"))).alias("turn", "variant"),
    )
    r = people.select("c", normalise(C("name")).alias("cn"), "age")
    r = settle(r, "people")
    counts = _words(r, "cn").groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    # a search for a variant returns the people whose name holds every word of it
    rare = _words(l, "variant").join(counts, "_w").groupBy("q", "turn").agg(
        F.min_by("_w", F.struct("_n", "_w")).alias("_w")
    )
    hits = block_join(rare, _words(r, "cn").select("c", "_w"), ["_w"], "c").drop("_w")
    hits = hits.join(l, ["q", "turn"]).join(r, "c")
    words = tokens(C("variant"))
    hits = hits.where(F.size(F.array_except(words, tokens(C("cn")))) == 0)
    scored = roster_name_score(hits)
    age_gap = F.abs(C("age") - C("expected"))
    score = C("ns") + F.when(C("age").isNull(), -12).when(age_gap <= 1, 10).otherwise(-40)
    scored = settle(scored.select("q", "turn", "c", F.round(score, 9).alias("score")), "variant-scores")
    # below the best score less its lead nothing decides
    two = _top_two(scored.where(C("score") >= 82.0 - 4.0), "q", "turn").join(of, "q")
    two = settle(two.select(F.struct(C("_of").alias("q"), "turn").alias("k"), "c", "score"), "variant-found")
    found = _with_margin(two, "k", 82.0, 4.0)
    return found.groupBy(C("k.q").alias("q")).agg(
        F.min_by(F.struct("match_id", "match_score"), "k.turn").alias("m")
    ).select("q", "m.match_id", "m.match_score")


def match_directory(clubs: DataFrame, directory: DataFrame) -> DataFrame:
    """Directory club of each club name; overrides first, then best >= 55 with a lead of 5.

    ``clubs``: q, name; ``directory``: c, name. Listed foreign names and youth teams never match.
    """
    l = clubs.select("q", normalise(C("name")).alias("qn"))
    l = l.where(~C("qn").isin(*config.DIRECTORY_SKIP) & ~is_youth_team(C("qn")))
    r = directory.select("c", normalise(C("name")).alias("cn"))
    table = F.create_map(*[F.lit(x) for pair in config.DIRECTORY_OVERRIDES.items() for x in pair])
    forced = (
        l.withColumn("cn", F.try_element_at(table, C("qn")))
        .join(r, "cn")
        .groupBy("q")
        .agg(F.min("c").alias("match_id"))
        .withColumn("match_score", F.lit(100.0))
    )
    l, r = settle(l, "clubs"), settle(r, "directory")
    left, right = l.select(C("qn").alias("qc")), r.select(C("cn").alias("cc"))
    related = club_pairs(left, right, config.ROSTER_CLUB_ALIASES, 10, 80)
    by_club = related.join(l, C("qc") == C("qn")).join(r, C("cc") == C("cn")).select("q", "c")
    ways = [(_words(l, "qn"), _words(r, "cn")), (_initials(l, "qn"), _first_letters(r, "cn"))]
    by_word = [block_join(a.drop("qn"), b.drop("cn"), ["_w"], "c").select("q", "c") for a, b in ways]
    pairs = by_club.unionByName(by_word[0]).unionByName(by_word[1]).distinct()

    def scores(pairs: DataFrame) -> DataFrame:
        named = roster_name_score(pairs.join(l, "q").join(r, "c"))
        named = named.join(related, (C("qn") == C("qc")) & (C("cn") == C("cc")), "left")
        score = F.greatest(F.coalesce(C("cs").cast("double"), F.lit(0.0)), C("ns"))
        return named.select("q", "c", F.round(score, 9).alias("score"))

    worded = settle(scores(pairs), "directory-words")
    # Spelling alone gives 88 x ratio. It matters where it comes within the lead of the best score by words, so
    # a club that words decide clearly asks for no spelling at all.
    best = worded.groupBy("q").agg(F.max("score").alias("peak"))
    need = F.greatest(F.lit(0.55), (F.coalesce("peak", F.lit(0.0)) - 5.0) / 88.0 - 1e-6)
    open_ = l.join(best, "q", "left").withColumn("_r", need).where(C("_r") <= 1).select("q", "qn", "_r")
    spelled = block_join(
        _spelling_keys(open_, "qn", C("_r")).select("q", "_w"), _spelling_keys(r, "cn", F.lit(0.55)).select("c", "_w"), ["_w"], "c"
    ).select("q", "c").distinct()
    spelled = spelled.join(worded, ["q", "c"], "left_anti").join(open_, "q").join(r, "c")
    spelled = spelled.where(_most_ratio(_numbered(C("qn")), _numbered(C("cn"))) >= C("_r") - 1e-9).select("q", "c")
    scored = settle(worded.unionByName(scores(spelled)), "directory-scores")
    found = _with_margin(scored, "q", 55.0, 5.0)
    return forced.unionByName(found.join(forced, "q", "left_anti"))


def pick_result(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Result of each query: a single hit wins, else club score plus name bonus of at least 40.

    ``queries``: q, name, club. ``results``: name, club, c, result_name, result_club; queries that agree in
    name and club have the same results, which are scored once.
    """
    rows = results.select(
        "name", "club", "c", normalise(C("name")).alias("qn"), normalise(C("club")).alias("qc"),
        normalise(C("result_name")).alias("cn"), normalise(C("result_club")).alias("cc"),
    )
    bonus = F.when(C("cn") == C("qn"), 25).when(C("cn").contains(C("qn")), 10).otherwise(0)
    club = club_score(C("qc"), C("cc"), config.ROSTER_CLUB_ALIASES, 10, 80)
    first = F.min_by(F.struct("c", "score"), F.struct(-C("score"), C("c"))).alias("b")
    kinds = settle(
        rows.withColumn("score", club + bonus).groupBy("name", "club").agg(F.count(F.lit(1)).alias("hits"), first),
        "result-kinds",
    ).select(C("name").alias("_name"), C("club").alias("_club"), "hits", "b.*")
    alike = C("name").eqNullSafe(C("_name")) & C("club").eqNullSafe(C("_club"))
    best = queries.where(C("q").isNotNull()).join(kinds, alike).groupBy("q").agg(F.sum("hits").alias("hits"), first)
    kept = (C("hits") == 1) | (C("b.score") >= 40)
    return best.where(kept).select("q", C("b.c").alias("match_id"), C("b.score").alias("score"))
