"""Match free-text notes to accounts: explicit id, then name similarity, then first word."""

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.dates import note_date_token, parse_note_date
from riskspark.functions.name_tree import best_names
from riskspark.functions.similarity import joined_length, lcs_best_first, subset_scores, token_set
from riskspark.functions.text import clean_header
from riskspark.functions.values import DEFAULT_NOTE_YEAR, SIMILARITY_CUTOFF
from riskspark.scratch import stored, task_count

# Fixed pattern: an account id named as such anywhere in the note.
EXPLICIT_ID = r"(?i)(?:acct|#|account)\s*(\d{4})"
# A token carried by more names than this is matched through grouped names instead of one by one.
COMMON_TOKEN_NAMES = 1000
# Buckets of 64 hashes of words; those in use are broadcast (16 bytes each) and stop other words of notes.
WORD_BUCKETS = 1 << 20
# Names and headers that meet in one cell of the character comparison.
NAMES_PER_CELL = 1 << 16
HEADS_PER_CELL = 1 << 15
# Behind every position of a name; what names without one have comes before it.
NO_ORDER = {"long": ((1 << 63) - 2, (1 << 63) - 1), "double": (sys.float_info.max / 2, sys.float_info.max)}
# Headers that meet few rows of a hot key (a common token, a length) are dealt over so many tasks; those rows visit each.
SPREAD = 16


def explicit_id(block: Column) -> Column:
    return F.nullif(F.regexp_extract(block, EXPLICIT_ID, 1), F.lit("")).cast("long")


def resolve_explicit(notes: DataFrame, accounts: DataFrame) -> DataFrame:
    """Notes that name an id; the id is kept as written, `id_known` says whether it exists."""
    return _known_ids(notes.select("note_pos", explicit_id(F.col("raw_text")).alias("explicit_id")), accounts)


def _known_ids(named: DataFrame, accounts: DataFrame) -> DataFrame:
    known = accounts.select("account_id").distinct().withColumn("_known", F.lit(True))
    return (named.where("explicit_id IS NOT NULL").select("note_pos", F.col("explicit_id").alias("account_id"))
            .join(known, "account_id", "left")
            .select("note_pos", "account_id", F.coalesce("_known", F.lit(False)).alias("id_known")))


def _names(accounts: DataFrame, order: str) -> DataFrame:
    """One row per name: its first position and, as a later duplicate overrides, its last id."""
    ordered = accounts.where(F.col("account_name").isNotNull()).withColumn("_ord", F.col(order))
    return ordered.groupBy("account_name").agg(
        F.min("_ord").alias("ord"), F.max_by("account_id", "_ord").alias("account_id"))


def _joined_tokens(text: Column) -> Column:
    """Sorted distinct tokens with one blank between them; `_tokens` takes them apart again."""
    return F.array_join(token_set(text), " ")


def _tokens(joined: Column) -> Column:
    return F.split(joined, " ")


def _scored(pairs: DataFrame, heads: DataFrame, cutoff: float) -> DataFrame:
    """Similarity of (header, name) pairs; texts and the character comparison only where they can matter, best bounds first.

    A header comes with those of its tokens that some name has, which hold all that a pair can share. A pair whose bound
    lies below what its header has already reached keeps its token score, which can't win.
    """
    total, known = F.col("len") + F.col("n_len"), F.when(F.col("shared") > 0, F.col("shared") + 1).otherwise(0)
    score = lambda reached: F.round(200.0 * reached / total, 9)  # floating point must not separate equal scores reached on different ways
    weighed = (pairs.withColumns({"n_len": F.length("joined"), "shared": joined_length(F.array_intersect("tokens", _tokens(F.col("joined"))))})
               .withColumn("score", F.round(subset_scores(F.col("shared"), F.col("len"), F.col("n_len")), 9)))
    reachable = score(F.least("len", "n_len"))
    near = weighed.where((F.col("score") < 100.0) & (reachable >= F.greatest(F.lit(cutoff), "score")))
    texts = heads.select("hid", F.col("joined").alias("header"))
    rest = lambda of, without: F.array_join(F.array_except(_tokens(F.col(of)), _tokens(F.col(without))), " ")
    compared = near.join(texts.hint("merge"), "hid").withColumns({"h_rest": rest("header", "joined"), "n_rest": rest("joined", "header")})
    compared = compared.withColumn("lcs", lcs_best_first(
        F.col("hid"), F.col("h_rest"), F.col("n_rest"), score(known + F.least(F.length("h_rest"), F.length("n_rest"))), F.lit(cutoff),
        known.cast("double"), total.cast("double")))
    by_chars = compared.where("lcs >= 0").withColumn("score", F.greatest("score", score(known + F.col("lcs"))))
    one = ["hid", "ord", "account_id", "account_name", "score"]
    return weighed.select(*one).unionByName(by_chars.select(*one))


def _best(scored: DataFrame, cutoff: float) -> DataFrame:
    """Highest score per header, the earlier account on ties."""
    rank = F.struct(F.col("score"), (-F.col("ord")).alias("earlier"))
    return (scored.where(F.col("score") >= cutoff).groupBy("hid")
            .agg(F.max_by(F.struct("score", "ord", "account_id", "account_name"), rank).alias("m"))
            .select("hid", "m.*"))


def _in_use(rows: DataFrame, word: str, words: DataFrame) -> DataFrame:
    """`rows` without most of those whose `word` is none of `words`, by one bit for each hash of a word."""
    bit = F.pmod(F.xxhash64(word), F.lit(WORD_BUCKETS * 64))
    of_bits = lambda at, shift: F.call_function(at, shift, F.col("_bit").bitwiseAND(F.lit(63)).cast("int"))
    table = (words.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_bucket"))
             .agg(F.bit_or(of_bits("shiftleft", F.lit(1).cast("long"))).alias("_bits")))
    return (rows.withColumn("_bit", bit).join(
        F.broadcast(table), (F.shiftright("_bit", 6) == F.col("_bucket"))
        & (of_bits("shiftright", F.col("_bits")).bitwiseAND(F.lit(1)) == 1), "left_semi").drop("_bit"))


def similarity_matches(headers: DataFrame, accounts: DataFrame, order: str = "account_id",
                       cutoff: float = SIMILARITY_CUTOFF, case_sensitive: bool = False,
                       common_names: int = COMMON_TOKEN_NAMES) -> DataFrame:
    """Best account per distinct header text by token-set similarity of at least `cutoff`."""
    keyed = headers.select("header").distinct().withColumn("joined", _joined_tokens(_folded(F.col("header"), case_sensitive)))
    found = _token_matches(keyed, accounts, order, cutoff, case_sensitive, common_names)
    return keyed.withColumn("key", _key("joined")).join(found.hint("merge"), "key").select("header", "account_id", "account_name", "score")


def _key(text: str) -> Column:
    """Stands for a text of any length where equal ones meet."""
    return F.unhex(F.sha2(F.encode(F.col(text), "UTF-8"), 256))


def _folded(text: Column, case_sensitive: bool) -> Column:
    return text if case_sensitive else F.lower(text)


def _token_matches(keyed: DataFrame, accounts: DataFrame, order: str, cutoff: float, case_sensitive: bool,
                   common_names: int) -> DataFrame:
    """Best account per distinct `joined` tokens of a header, by their `_key`.

    Exact, without comparing everything with everything. A pair reaches the cutoff through
    shared tokens or through shared characters:
    - tokens few names carry: equi-join on the token, at most `common_names` names each;
    - tokens many names carry: such scores only depend on which common tokens a name has and on
      its length, so names are grouped by that and one (the earliest) stands for its group;
    - characters: `_character_matches`. Headers already at 100 skip this step.
    Only ids and tokens are shuffled until pairs are known; texts join those.
    """
    heads = stored(keyed.select("joined").where("joined <> ''").distinct().withColumn("hid", F.monotonically_increasing_id()))
    names = (_names(accounts, order).withColumn("joined", _joined_tokens(_folded(F.col("account_name"), case_sensitive)))
             .where("joined <> ''").groupBy("joined").agg(F.min(F.struct("ord", "account_id", "account_name")).alias("f"))
             .select("joined", "f.*"))
    names = stored(names)

    # Stored tables are small as files and large as rows, so no size of a file may choose a broadcast: joins are merged.
    name_tokens = names.select("*", F.explode(_tokens(F.col("joined"))).alias("token"))
    token_use = stored(name_tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses")))
    often = F.broadcast(stored(token_use.where(F.col("uses") > common_names).select("token")))  # at most one in `common_names` uses
    used = stored(_in_use(heads.select("hid", F.length("joined").alias("len"), F.explode(_tokens(F.col("joined"))).alias("token")),
                          "token", token_use).groupBy("hid", "len").agg(F.array_sort(F.collect_list("token")).alias("tokens")))
    head_tokens = used.select("*", F.explode("tokens").alias("token"))

    rare = name_tokens.join(often, "token", "left_anti")
    pairs = stored(head_tokens.join(often, "token", "left_anti").join(rare.hint("merge"), "token").drop("token"))
    lengths = names.agg(F.array_sort(F.collect_set(F.length("joined")))).first()[0]
    # By characters only headers near some name in length can match; no other text is shuffled.
    short = heads.where(F.round(F.length("joined") * (cutoff / (200.0 - cutoff)), 6) <= (lengths or [0])[-1])
    by_rare = _scored(pairs, short, cutoff)

    # Names grouped by (their common tokens, length): enough to score what only common tokens share.
    head_common = head_tokens.join(often, "token", "left_semi")
    name_common = stored(name_tokens.join(often, "token", "left_semi").groupBy("joined", "ord", "account_id", "account_name")
                         .agg(F.array_sort(F.collect_list("token")).alias("common")))
    common = stored(name_common.groupBy("common", F.length("joined").alias("len"))
                    .agg(F.min(F.struct("ord", "account_id", "account_name")).alias("f")).select("common", "len", "f.*"))
    head_sets = stored(head_common.groupBy("hid", "len").agg(F.array_sort(F.collect_list("token")).alias("common")))
    shared = joined_length(F.array_intersect("h.common", "n.common"))
    by_common = (
        _dealt(head_sets.select("*", F.explode("common").alias("token")), "hid").alias("h")
        .join(_everywhere(common.select("*", F.explode("common").alias("token"))).alias("n").hint("merge"),
              (F.col("h.token") == F.col("n.token")) & (F.col("h.deal") == F.col("n.deal")))
        .select("h.hid", "n.ord", "n.account_id", "n.account_name",
                F.round(subset_scores(shared, F.col("h.len"), F.col("n.len")), 9).alias("score")))
    by_tokens = stored(_best(by_rare.unionByName(by_common), cutoff))
    by_chars = _character_matches(short, by_tokens, lengths, head_sets, names, name_common, common, cutoff)
    best = _best(by_tokens.unionByName(by_chars), cutoff)
    return heads.select("hid", _key("joined").alias("key")).join(best.hint("merge"), "hid").drop("hid")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("deal", F.pmod(F.xxhash64(key), F.lit(SPREAD)).cast("int"))


def _everywhere(rows: DataFrame) -> DataFrame:
    return rows.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))


def _open(heads: DataFrame, found: DataFrame, cutoff: float) -> DataFrame:
    """Headers that can still be matched better: the score a better match must reach, and the first and last length of names that can."""
    known = found.select("hid", F.col("score").alias("found"), F.col("ord").alias("found_ord"))
    length, near = F.length("joined"), F.col("floor") / (200.0 - F.col("floor"))  # shortest/longest that can qualify
    return (heads.join(known.hint("merge"), "hid", "left").where(F.coalesce("found", F.lit(0.0)) < 100.0)
            .withColumn("floor", F.greatest(F.lit(cutoff), F.coalesce("found", F.lit(0.0))))
            .withColumn("first", F.ceil(F.round(length * near, 6)).cast("int"))
            .withColumn("last", F.floor(F.round(length / near, 6)).cast("int")).drop("found"))


def _character_matches(heads: DataFrame, found: DataFrame, lengths: list[int], head_sets: DataFrame, names: DataFrame,
                       name_common: DataFrame, common: DataFrame, cutoff: float) -> DataFrame:
    """Best name per header by the characters that are left without shared tokens, where that reaches the header's floor.

    Pairs that share a rare token are scored already. All others share some set of common tokens, mostly none, and what is
    left of both is compared: names are sorted by that and cut into cells of one set and length, each header visits the cells
    of lengths that allow its floor, and finds its best name there through the names' shared beginnings (`best_names`).
    """
    heads = stored(_open(heads, found, cutoff))
    lengths = F.array(*map(F.lit, lengths)).cast("array<int>")
    names = names.select(F.lit("").alias("shared"), F.length("joined").alias("len"), F.col("joined").alias("rest"),
                         "ord", "account_id", "account_name")
    visitors = heads.select("*", F.lit("").alias("shared"), F.col("joined").alias("rest"))
    # What headers and names can share of common tokens: an inner join of the distinct sets on both sides.
    open_sets = head_sets.join(heads.select("hid").hint("merge"), "hid", "left_semi")
    sets = lambda of: of.select("common").distinct().select("common", F.explode("common").alias("token"))
    meets = stored(sets(open_sets).withColumnRenamed("common", "h_common")
                   .join(sets(common).withColumnRenamed("common", "n_common").hint("merge"), "token")
                   .select("h_common", "n_common", F.array_intersect("h_common", "n_common").alias("both")).distinct())
    if not meets.isEmpty():
        rest = F.array_join(F.array_except(_tokens(F.col("joined")), F.col("both")), " ").alias("rest")
        shared = F.array_join("both", " ").alias("shared")
        of_heads, of_names = (meets.select(F.col(side).alias("common"), "both").distinct().hint("merge") for side in ("h_common", "n_common"))
        names = names.unionByName(name_common.join(of_names, "common").select(
            shared, F.length("joined").alias("len"), rest, "ord", "account_id", "account_name"))
        visitors = visitors.unionByName(heads.join(open_sets.select("hid", "common").hint("merge"), "hid")
                                        .join(of_heads, "common").select(*heads.columns, shared, rest))

    spread, kind = task_count(names.sparkSession), names.schema["ord"].dataType
    key = ["shared", "len", "cell"]
    order = "long" if isinstance(kind, T.IntegralType) else "double"
    names = stored(names.where("rest <> ''").repartitionByRange(spread, "shared", "len", "rest")
                   .sortWithinPartitions("shared", "len", "rest").withColumn("nid", F.monotonically_increasing_id())
                   .withColumn("cell", F.floor(F.col("nid") / NAMES_PER_CELL)))
    cells = stored(names.select(*key).distinct())
    known = F.when(F.col("shared") != "", F.length("shared") + 1).otherwise(0)
    visitors = (visitors.where("rest <> ''").withColumn("known", known)
                .withColumn("len", F.explode(F.filter(lengths, lambda n: n.between(F.col("first"), F.col("last"))))))
    visits = lambda cells: _dealt(visitors, "hid").join(_everywhere(cells).hint("merge"), ["shared", "len", "deal"])
    # Many names or headers may meet: both are cut, and every part of one side visits each of the other.
    # The fixed partition count keeps the few but costly rows from being packed into one task.
    visited = visits(cells).groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / HEADS_PER_CELL).cast("int").alias("parts"))
    cells = stored(cells.join(visited.hint("merge"), key))
    part, (unknown, none) = F.pmod(F.xxhash64("hid"), F.col("parts")).cast("int").alias("part"), NO_ORDER[order]
    heads_of = visits(cells).select(*key, part, "hid", "rest", "known", (F.length("joined") + F.col("len")).alias("total"), "floor",
                                    F.coalesce(F.col("found_ord").cast(order), F.lit(none)).alias("before"))
    names_of = (names.join(cells.select(*key, "parts").hint("merge"), key)
                .select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "nid", "rest",
                        F.coalesce(F.col("ord").cast(order), F.lit(unknown)).alias("ord")))
    group = lambda rows: rows.repartition(spread, *key, "part").groupBy(*key, "part")
    schema = f"hid long, nid long, ord {order}, shared_length long, total long"
    score = F.round(200.0 * F.col("shared_length") / F.col("total"), 9)
    best = (group(heads_of).cogroup(group(names_of)).applyInPandas(best_names, schema)
            .groupBy("hid").agg(F.max_by(F.struct("nid", score.alias("score")), F.struct(score, -F.col("ord"))).alias("m")).select("hid", "m.*"))
    return (best.join(names.select("nid", "ord", "account_id", "account_name").hint("merge"), "nid")
            .select("hid", "ord", "account_id", "account_name", "score"))


def resolve_fuzzy(notes: DataFrame, accounts: DataFrame, order: str = "account_id",
                  case_sensitive: bool = False, **options) -> DataFrame:
    keyed = stored(notes.select("note_pos", _header_tokens(case_sensitive).alias("joined")))
    return _fuzzy(keyed, accounts, order, case_sensitive, **options)


def _header_tokens(case_sensitive: bool) -> Column:
    return _joined_tokens(_folded(clean_header(F.col("raw_text")), case_sensitive))


def _fuzzy(keyed: DataFrame, accounts: DataFrame, order: str, case_sensitive: bool, cutoff: float = SIMILARITY_CUTOFF,
           common_names: int = COMMON_TOKEN_NAMES) -> DataFrame:
    found = _token_matches(keyed, accounts, order, cutoff, case_sensitive, common_names)
    return keyed.select("note_pos", _key("joined").alias("key")).join(found.hint("merge"), "key").select(
        "note_pos", "account_id", "account_name", F.col("score").alias("match_score"))


def _pieces(text: Column) -> Column:
    """Runs of word characters and runs of other marks, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]+"), F.lit(0))


def _spans(pieces: Column, sizes: Column) -> Column:
    """All sequences of `sizes` neighbouring pieces that stand between word boundaries.

    A piece of marks begins or ends at a boundary only where a word piece is next to it.
    """
    words = F.transform(pieces, lambda p: p.rlike(r"(?U)^\w"))
    bound = lambda at: F.coalesce(F.element_at(words, at), F.lit(False))  # positions from 1
    of_size = lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.size(pieces) - n + 1),
                 lambda i: (bound(i) | F.when(i > 1, bound(i - 1)).otherwise(False))
                 & (bound(i + n - 1) | F.when(i + n <= F.size(pieces), bound(i + n)).otherwise(False))),
        lambda i: F.array_join(F.slice(pieces, i, n), ""))
    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.size(pieces)), of_size)))


def resolve_first_word(notes: DataFrame, accounts: DataFrame, order: str = "account_id") -> DataFrame:
    """Notes that contain the first word of an account name as a whole word; first account wins.

    A text is cut at white space and each part into pieces of word characters and of other marks. A first word
    stands between word boundaries exactly where it equals some neighbouring pieces, so those are exploded and
    equi-joined to the distinct first words. Only sequences as long as some first word are built, and only those
    whose hash some first word has are shuffled.
    """
    word = F.lower(F.element_at(token_words(F.col("account_name")), 1))
    words = (_names(accounts, order).withColumn("word", word).where("word is not null")
             .groupBy("word").agg(F.min(F.struct("ord", "account_id", "account_name")).alias("first")))
    sizes = words.select(F.collect_set(F.size(_pieces(F.col("word"))))).scalar()
    parts = notes.select("note_pos", F.explode(F.array_distinct(token_words(F.lower("raw_text")))).alias("part"))
    plain = F.col("part").rlike(r"(?U)^\w+$")  # most parts are one piece
    pieces = parts.select("note_pos", "part", F.when(~plain, _pieces(F.col("part"))).alias("pieces"), sizes.alias("sizes"))
    spans = F.when(F.col("pieces").isNotNull(), _spans(F.col("pieces"), F.col("sizes"))).when(
        F.array_contains("sizes", 1), F.array("part"))
    likely = _in_use(pieces.select("note_pos", F.explode(spans).alias("word")), "word", words)
    return (likely.join(words.hint("merge"), "word")
            .groupBy("note_pos").agg(F.min("first").alias("m"))
            .select("note_pos", "m.account_id", "m.account_name"))


def token_words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def resolve_notes(notes: DataFrame, accounts: DataFrame, order: str = "account_id",
                  case_sensitive: bool = False, narrow_slash: bool = False,
                  default_year: int = DEFAULT_NOTE_YEAR, texts: bool = True) -> DataFrame:
    """The cascade: each step only sees the notes the steps before left open. Without `texts` they are not read again for the result."""
    note_date = parse_note_date(note_date_token(F.col("raw_text"), narrow_slash), default_year).alias("note_date")
    # One narrow row per note serves the first steps; texts are read again for words and for the result only.
    slim = stored(notes.select(
        "note_pos", explicit_id(F.col("raw_text")).alias("explicit_id"), _header_tokens(case_sensitive).alias("joined"), note_date)
        .withColumn("joined", F.when(F.col("explicit_id").isNull(), F.col("joined"))))
    by_id = _known_ids(slim, accounts)
    by_name = stored(_fuzzy(slim.where("explicit_id IS NULL"), accounts, order, case_sensitive))
    by_word = (resolve_first_word(notes.where(explicit_id(F.col("raw_text")).isNull()), accounts, order)
               .join(by_name.select("note_pos").hint("merge"), "note_pos", "left_anti"))
    no_score = F.lit(None).cast("double").alias("match_score")
    matches = (
        by_id.select("note_pos", "account_id", F.lit(None).cast("string").alias("account_name"),
                     F.lit("explicit").alias("match_method"), no_score, "id_known")
        .unionByName(by_name.select("*", F.lit("similarity").alias("match_method"),
                                    F.lit(True).alias("id_known")))
        .unionByName(by_word.select("*", F.lit("first_word").alias("match_method"), no_score,
                                    F.lit(True).alias("id_known"))))
    dated = notes.select("note_pos", "raw_text", note_date) if texts else slim
    return dated.join(matches, "note_pos", "left").select(
        "note_pos", "note_date", "account_id", "account_name", *(["raw_text"] if texts else []),
        "match_method", "match_score", F.coalesce("id_known", F.lit(False)).alias("id_known"))
