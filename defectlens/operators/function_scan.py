"""Where functions start and end, and their plain counts, as windows over one row per token of a source file.

Two layouts are told apart: functions delimited by indentation (Python, Ruby) and by braces (all others). The first is
exact for well-formed Python, the second a best effort. What a nested function holds counts for it alone.

Files are hashed by path once; all windows lie within a file and need no further shuffle. Equal rows are scanned once
and given back as often as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

STRING = r'"(?:[^"\\\n]|\\.)*+"' + r"|'(?:[^'\\\n]|\\.)*+'"
LONG_STRING = r'"""(?:[^\\"]|\\.|"(?!""))*+"""' + r"|'''(?:[^\\']|\\.|'(?!''))*+'''"
# Letters beyond ASCII all count as parts of words: classes of Unicode make the search much slower.
LETTER = r"\w\x{80}-\x{10FFFF}"
WORD = rf"\d[{LETTER}.]*|[{LETTER}&&[^\d]][{LETTER}]*"
OPERATOR = r"=>|->|\*\*=?|//=?|<<=?|>>=?|\?[.?:]|::|:=|&&|\|\||[-+*/%&|^<>=!]=|\.\.\.?|\S"
LINE_END = r"\n[ \t]*"
# A word that runs into a quote is the prefix of a string.
INDENTED = rf"""(?:{WORD})(?!["'{LETTER}])|\#[^\n]*|\\\n|[a-zA-Z]{{0,2}}(?:{LONG_STRING}|{STRING})|{OPERATOR}"""
INDENTED_ROW = rf"(?s)\n((?:[^\S\n]*(?:{INDENTED}))*+)"
INDENTED_TOKEN = rf"(?s)({INDENTED})"
BRACED = rf"(?s)[ \t]*({LINE_END}|{WORD}|/\*.*?\*/|//[^\n]*|{STRING}|`(?:[^`\\]|\\.)*+`|{OPERATOR})"

# Words and signs that add a path, that open a block which is no function, that declare a function,
# and that may stand on their own line between a parameter list and its brace.
DECISIONS = [
    "if", "elif", "elsif", "for", "foreach", "while", "until", "unless", "case", "when", "catch", "except", "rescue",
    "and", "or", "&&", "||", "?",
]
BLOCKS = [
    "if", "else", "for", "foreach", "while", "switch", "catch", "do", "try", "finally", "guard", "match", "select",
    "using", "lock", "synchronized", "class", "struct", "interface", "enum", "namespace", "object", "new", "defer",
]
DECLARES = ["func", "function", "fun", "async"]
BEFORE_BRACE = ["{", "throws", "->", ":", "const", "noexcept", "override", "where"]
OPENING, CLOSING = ["(", "[", "{"], [")", "]", "}"]
ANONYMOUS = "(anonymous)"
NO_PIECE = ["*", "/", "void"]

FILE = ["digest", "path"]  # the number first: sorts tell most files apart by it
TOKEN = [*FILE, "copies", "i", "text", "line", "last_line", "column"]
COUNTS = ["lines", "paths", "size"]  # of a line: lines of code, paths added, words
EXTENT = "struct<name:string,first:int,last:int,start_line:int,end_line:int,bracket:int>"


def _ordered(*keys: str, by: tuple[str, ...] = ("i",)) -> WindowSpec:
    return Window.partitionBy(*FILE, *keys).orderBy(*by)


def _before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _until(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def _last(condition: Column, value: Column, window: WindowSpec) -> Column:
    """The latest value for which the condition held."""
    return F.last(F.when(condition, value), ignorenulls=True).over(window)


def _step(opening: list[str], closing: list[str]) -> Column:
    text = F.col("text")
    return F.when(text.isin(opening), 1).when(text.isin(closing), -1).otherwise(0)


def _with_depth(tokens: DataFrame, name: str, opening: list[str], closing: list[str], window: WindowSpec) -> DataFrame:
    """Open brackets after each token; one that closes nothing is passed over."""
    until = _until(window)
    tokens = tokens.withColumn("_sum", F.sum(_step(opening, closing)).over(until))
    lowest = F.least(F.lit(0), F.min("_sum").over(until))
    return tokens.withColumn(name, F.col("_sum") - lowest).drop("_sum")


def _matches(files: DataFrame, pattern: str) -> DataFrame:
    """A row per match, numbered within its file; a line break is put before the text."""
    # A number of partitions is given because adaptive execution would merge them by the size of the files, not of the rows.
    spark = files.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    unique = files.repartition(parts, "path").groupBy("path", "content").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    found = F.regexp_extract_all(F.concat(F.lit("\n"), "content"), F.lit(pattern), F.lit(1))
    return unique.select("path", F.xxhash64("content").alias("digest"), "copies", F.posexplode(found).alias("i", "text"))


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _tokens(files: DataFrame) -> DataFrame:
    """A row per token that is no comment: number, text, first and last line, and its column if it starts a line, else -1."""
    by_place = _ordered()
    text = F.col("text")
    rows = _matches(files, BRACED).withColumn("breaks", _breaks(text))
    rows = rows.withColumn("line", F.coalesce(F.sum("breaks").over(_before(by_place)), F.lit(0)).cast("int"))
    code = rows.where(~(text.startswith("//") | text.startswith("/*")))
    before = F.lag("text").over(by_place)
    code = code.withColumn("column", F.when(before.startswith("\n"), F.length(before) - 1).otherwise(-1))
    code = code.where(~text.startswith("\n")).withColumn("last_line", F.col("line") + F.col("breaks"))
    return code.withColumn("i", F.row_number().over(by_place)).select(TOKEN)


def _piece_count(tokens: Column) -> Column:
    """Pieces between the top-level commas up to the bracket that closes the list, without bare ``*``, ``/`` and ``void``."""

    def close(state: Column) -> Column:
        counts = (state["length"] > 0) & ~((state["length"] == 1) & state["latest"].isin(NO_PIECE))
        return state["pieces"] + counts.cast("int")

    def move(state: Column, token: Column) -> Column:
        step = F.when(token.isin(OPENING), 1).when(token.isin(CLOSING), -1).otherwise(0)
        angle = step + F.when(token == "<", 1).when(token == ">", -1).otherwise(0)
        over = state["over"] | (state["open"] + step < 0)
        cut = (token == ",") & (state["inner"] + angle == 0)
        after = lambda same, at_cut, other: F.when(over, same).when(cut, at_cut).otherwise(other)
        return F.struct(
            over.alias("over"),
            (state["open"] + step).alias("open"),
            (state["inner"] + angle).alias("inner"),
            after(state["pieces"], close(state), state["pieces"]).alias("pieces"),
            after(state["length"], F.lit(0), state["length"] + 1).alias("length"),
            after(state["latest"], token, token).alias("latest"),
        )

    zero = F.lit(0)
    start = F.struct(F.lit(False).alias("over"), zero.alias("open"), zero.alias("inner"), zero.alias("pieces"),
                     zero.alias("length"), F.lit("").alias("latest"))
    return F.aggregate(tokens, start, move, close)


def indented_functions(files: DataFrame) -> DataFrame:
    """``files`` (path, content) of Python and Ruby to one row of counts per function; null content has none.

    The windows hold a row per line; a string or bracket over several lines stays whole. A function ends before the next
    statement that is indented no deeper than its ``def``. A statement can only be the first one at or below a level
    when the statement before it lies at that level or above, so it is put beside the functions of these levels alone,
    and each function looks one row ahead. A ``def`` without a name on its line is none.
    """
    w, text, words = _ordered(), F.col("text"), F.col("words")
    rows = _matches(files, INDENTED_ROW).withColumn("breaks", _breaks(text))
    rows = rows.withColumn("line", (F.coalesce(F.sum(F.col("breaks") + 1).over(_before(w)), F.lit(0)) + 1).cast("int"))
    found = F.regexp_extract_all("text", F.lit(INDENTED_TOKEN), F.lit(1))
    rows = rows.withColumn("words", F.filter(found, lambda t: ~t.startswith("#") & ~t.startswith("\\\n")))
    rows = rows.where(F.size("words") > 0)
    sums = F.aggregate(
        F.filter(words, lambda t: t.isin(OPENING + CLOSING)),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("low")),
        lambda state, t: F.struct(
            (state["sum"] + F.when(t.isin(OPENING), 1).otherwise(-1)).alias("sum"),
            F.least(state["low"], state["sum"] + F.when(t.isin(OPENING), 1).otherwise(-1)).alias("low"),
        ),
    )
    is_async = F.try_element_at(words, F.lit(1)) == "async"
    skip = F.when(is_async, 2).otherwise(1)
    rows = rows.select(
        *FILE, "copies", "i", "words", "line", (F.col("line") + F.col("breaks")).alias("last_line"),
        F.size(words).alias("size"), F.element_at(words, 1).alias("word"), F.size(F.filter(words, lambda t: t.isin(DECISIONS))).alias("paths"),
        F.length(F.regexp_extract("text", "^[ \t]*", 0)).alias("column"),
        sums.alias("brackets"),
        skip.alias("skip"),
        ((F.try_element_at(words, skip) == "def") & (F.size(words) > skip)).alias("is_def"),
        (F.element_at(words, 1).endswith('"""') | F.element_at(words, 1).endswith("'''")).alias("is_text"),
    )
    rows = rows.withColumn("sum_before", F.coalesce(F.sum("brackets.sum").over(_before(w)), F.lit(0)))
    lowest = F.min(F.col("sum_before") + F.col("brackets.low")).over(_before(w))
    rows = rows.withColumn("starts", F.col("sum_before") == F.least(F.lit(0), F.coalesce(lowest, F.lit(0))))
    rows = rows.withColumn("heads", F.col("starts") & F.col("is_def")).withColumns({
        "earlier": _last(F.col("starts"), F.struct("column", "heads"), _before(w)),
        "in_head": F.coalesce(_last(F.col("starts"), F.col("heads"), _until(w)), F.lit(False)),
        "line_before": F.lag("last_line").over(w),
        "levels": F.collect_set(F.when(F.col("heads"), F.col("column"))).over(Window.partitionBy(*FILE)),
        "file_end": F.max("last_line").over(Window.partitionBy(*FILE)),
    })
    is_text = F.coalesce(F.col("starts") & F.col("earlier.heads") & F.col("is_text"), F.lit(False))
    lines = F.when(~is_text, F.col("last_line") - F.col("line") + 1).otherwise((F.col("size") > 1).cast("int"))
    rows = rows.withColumns({"words": F.when(F.col("in_head"), words), "lines": lines})
    place = lambda level, own: F.struct(level.alias("level"), F.lit(own).alias("own"))
    closes = F.filter("levels", lambda k: (
        F.col("starts") & (k >= F.col("column")) & (k <= F.col("earlier.column"))
        & ~(F.col("heads") & (k == F.col("column")))
    ))
    rows = rows.withColumn("closes", F.coalesce(closes, F.array().cast("array<int>")))
    # Only lines of headers and lines that may close a function go on; what lies between two of them has one owner and is the
    # difference of running sums.
    sums = {c: F.sum(c).over(_until(w)) for c in COUNTS}
    rows = rows.withColumns({f"{c}_sum": total for c, total in sums.items()})
    rows = rows.withColumns({f"{c}_all": F.max(f"{c}_sum").over(Window.partitionBy(*FILE)) for c in COUNTS})
    rows = rows.where(F.col("in_head") | (F.size("closes") > 0))
    between = {c: F.lead(F.col(f"{c}_sum") - F.col(c)).over(w) for c in COUNTS}
    rows = rows.withColumns({f"{c}_then": F.coalesce(total, F.col(f"{c}_all")) - F.col(f"{c}_sum") for c, total in between.items()})
    beside = F.transform("closes", lambda k: place(k, False))
    own = F.array(place(F.when(F.col("heads"), F.col("column")), True))
    t = rows.withColumn("place", F.explode(F.concat(own, beside)))
    t = t.withColumns({"level": F.col("place.level"), "own": F.col("place.own")}).drop("place", "levels", "earlier", "closes")
    following = F.struct("i", "word", "column", "line", "line_before")
    t = t.withColumn("closer", F.lead(following).over(_ordered("level"))).where("own")

    closer = F.col("closer")
    at_end = (closer["word"] == "end") & (closer["column"] == F.col("column"))
    end_line = F.when(closer.isNull(), F.col("file_end")).when(at_end, closer["line"]).otherwise(closer["line_before"])
    extent = F.struct(
        F.element_at(words, F.col("skip") + 1).alias("name"), F.col("i").alias("first"), F.col("line").alias("start_line"),
        end_line.alias("end_line"), F.col("skip"),
        F.coalesce(F.try_element_at(words, F.col("skip") + 2) == "(", F.lit(False)).alias("listed"),
    )
    t = t.withColumn("extent", F.when(F.col("heads"), extent))
    nothing = {c: F.lit(0).cast("long") for c in COUNTS}

    def event(at: Column, kind: int, head: Column | None = None, counts: dict[str, Column] = nothing) -> Column:
        head = F.lit(None).cast("struct<i:int,words:array<string>>") if head is None else head
        return F.struct(at.cast("int").alias("at"), F.lit(kind).alias("kind"), head.alias("head"), *[n.cast("long").alias(c) for c, n in counts.items()])

    header_words = F.when(F.col("heads"), F.col("skip")).otherwise(0)  # ``def`` and ``async``
    head = F.when(F.col("in_head"), F.struct("i", "words"))
    own = event(F.col("i") * 2, 0, head, {"lines": F.col("lines"), "paths": F.col("paths"), "size": F.col("size") - header_words})
    then = event(F.col("i") * 2 + 2, 0, counts={c: F.col(f"{c}_then") for c in COUNTS})
    start = event(F.col("i") * 2 - 1, 1)
    end = event(closer["i"] * 2 + F.when(at_end, 1).otherwise(-1), -1)
    some = F.when(F.col("size_then") > 0, F.array(own, then)).otherwise(F.array(own))
    events = F.when(~F.col("heads"), some).when(closer.isNull(), F.concat(some, F.array(start))).otherwise(F.concat(some, F.array(start, end)))
    by_event = ("at", "kind")
    t = t.select(*FILE, "copies", "extent", F.inline(events))
    t = t.withColumn("depth", F.sum("kind").over(_until(_ordered(by=by_event)))).where("kind >= 0 AND depth > 0")
    t = t.withColumn("owner", _last(F.col("kind") == 1, F.col("extent"), _until(_ordered("depth", by=by_event)))).where("kind = 0")

    counted = t.groupBy(*FILE, "copies", "owner").agg(
        F.sum("lines").alias("nloc"), (1 + F.sum("paths")).alias("ccn"), F.sum("size").alias("token"),
        F.sort_array(F.collect_list("head")).alias("head"),
    )
    owner = F.col("owner")
    listed = F.flatten(F.transform("head", lambda x: x["words"]))
    flat = F.element_at("head", 1)["words"]
    after = lambda array, n: F.slice(array, n, F.size(array))
    params = F.when(owner["listed"], _piece_count(after(listed, owner["skip"] + 3))).otherwise(
        _piece_count(after(flat, owner["skip"] + 2)))
    return _function_columns(counted, params)


def _function_columns(counted: DataFrame, params: Column) -> DataFrame:
    owner = F.col("owner")
    whole = lambda name, c: c.cast("int").alias(name)
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        "path", owner["name"].alias("name"), owner["start_line"].alias("start_line"), owner["end_line"].alias("end_line"),
        whole("nloc", F.col("nloc")), whole("ccn", F.col("ccn")), whole("token", F.col("token")), whole("params", params),
        whole("length", owner["end_line"] - owner["start_line"] + 1),
    )


def _braced_extents(tokens: DataFrame) -> DataFrame:
    """A brace opens a function after a parameter list that follows a name, a declaring word or precedes an arrow.

    A frame is what lies directly within one pair of braces; its stretches end at braces and semicolons. Within a stretch
    the first name before a list counts, from the latest declaring word or the end of a call on a line of its own.
    """
    w, text = _ordered(), F.col("text")
    t = _with_depth(tokens, "depth", ["{"], ["}"], w)
    t = t.withColumns({f"{name}{n}": F.lag(name, n).over(w) for name in ("text", "line") for n in (1, 2)})
    # The frame of a token is told by the latest brace that led to its depth; the brace itself lies in the frame around.
    opens = text == "{"
    places = F.when(opens, F.array(
        F.struct((F.col("depth") - 1).alias("depth"), F.lit(True).alias("own")),
        F.struct(F.col("depth"), F.lit(False).alias("own")),
    )).otherwise(F.array(F.struct(F.col("depth"), F.lit(True).alias("own"))))
    t = t.withColumn("place", F.explode(places)).withColumns({"depth": F.col("place.depth"), "own": F.col("place.own")})
    t = t.drop("place").withColumn("frame", F.coalesce(_last(~F.col("own"), F.col("i"), _until(_ordered("depth"))), F.lit(0)))
    t = t.where("own").drop("own", "depth")

    in_frame = _ordered("frame")
    t = _with_depth(t, "parens", ["("], [")"], in_frame)
    t = t.withColumn("parens_before", F.coalesce(F.lag("parens").over(in_frame), F.lit(0)))
    ends = text.isin("{", "}") | ((text == ";") & (F.col("parens") == 0))
    number = F.col("i")
    t = t.withColumns({
        "since": F.coalesce(_last(ends, number, _before(in_frame)), F.lit(0)),
        "may_name": F.coalesce(
            (text == "(") & (F.col("parens_before") == 0) & F.col("text1").rlike(r"^[\p{L}_$]")
            & ~F.col("text1").isin(BLOCKS + DECLARES) & (F.coalesce(F.col("text2"), F.lit("")) != "@"), F.lit(False)),
        "pair": F.when(text == "(", F.col("parens")).when((text == ")") & (F.col("parens_before") > 0), F.col("parens") + 1),
    })
    t = t.withColumn("opener", F.lag(F.struct("i", "line", "may_name")).over(_ordered("frame", "pair")))

    matched = F.when(F.col("pair").isNotNull(), F.col("opener"))
    closed = F.struct(matched["i"].alias("start"), matched["line"].alias("line"), matched["may_name"].alias("may_name"),
                      number.alias("end"))
    declares = text.isin(DECLARES)
    in_stretch = lambda value, place: F.when(value[place] > F.col("since"), value)
    t = t.withColumns({
        "group_before": _last(text == ")", closed, _before(in_frame)),
        "group": _last(text == ")", closed, _until(in_frame)),
        "declared": _last(declares, number, _until(in_frame)),
        "block": _last(text.isin(BLOCKS) | declares, F.struct((~declares).alias("holds"), "i"), _until(in_frame)),
        "name_before": F.coalesce(_last(F.col("may_name"), number, _before(in_frame)), F.lit(-1)),
    })
    t = t.withColumns({
        "group_before": in_stretch(F.col("group_before"), "end"), "group": in_stretch(F.col("group"), "end"),
        "declared": F.coalesce(F.col("declared") > F.col("since"), F.lit(False)),
        "blocked": in_stretch(F.col("block"), "i")["holds"],
    }).drop("block")
    goes_on = text.isin(BEFORE_BRACE + [","]) | F.col("text1").isin(",", ":")
    t = t.withColumn("new_line", F.coalesce((F.col("column") >= 0) & ~goes_on & F.col("group_before.may_name"), F.lit(False)))
    seen = F.coalesce(_last(F.col("new_line"), number, _before(in_frame)), F.lit(-1))
    t = t.withColumn("call_over", F.col("new_line") & (seen < F.col("group_before.end")))
    part = F.coalesce(_last(declares | F.col("call_over"), number, _until(in_frame)), F.lit(0))
    t = t.withColumn("part", F.greatest(part, F.col("since")))
    name = F.struct((number - 1).alias("i"), F.col("text1").alias("text"), F.col("line1").alias("line"), number.alias("bracket"))
    named = _last(F.col("may_name") & (F.col("name_before") < F.col("part")), name, _until(in_frame))
    t = t.withColumn("named", named)
    t = t.withColumn("named", F.when(F.col("named.bracket") >= F.col("part"), in_stretch(F.col("named"), "bracket")))

    group, named = F.col("group"), F.col("named")
    none = F.lit(None).cast("int")
    free = ~F.coalesce(F.col("blocked"), F.lit(False)) & group["start"].isNotNull()
    head = lambda called, first, line, bracket: F.struct(
        called.alias("name"), first.cast("int").alias("first"), line.alias("line"), bracket.cast("int").alias("bracket"))
    anonymous = head(F.lit(ANONYMOUS), group["start"], group["line"], group["start"])
    arrow = (F.col("text1") == "=>") & (F.col("i") > 2)
    opened = (
        F.when(arrow & (group["start"].isNotNull()) & (group["end"] == F.col("i") - 2), anonymous)
        .when(arrow, head(F.lit(ANONYMOUS), F.col("i") - 2, F.col("line2"), none))
        .when(free & (F.col("parens") == 0) & (group["start"] > named["i"]),
              head(named["text"], named["i"], named["line"], named["i"] + 1))
        .when(free & F.col("declared"), anonymous)
    )
    # Within a frame a closing brace comes right after the brace that it closes.
    t = t.withColumn("opened", F.when(opens, opened)).select(*TOKEN, "frame", "opened")
    t = t.withColumn("head", F.lag(F.struct("text", "opened")).over(in_frame))
    opened = F.col("head.opened")
    extent = F.struct(opened["name"], opened["first"], F.col("i"), opened["line"], F.col("line"), opened["bracket"]).cast(EXTENT)
    extent = F.when((text == "}") & (F.col("head.text") == "{") & opened.isNotNull(), extent)
    return t.select(*TOKEN, extent.alias("extent"))


def _counts(tokens: DataFrame) -> DataFrame:
    """A row of counts per extent. Each token belongs to the innermost extent around it; the words of a header to none."""
    event = lambda at, kind: F.struct(at.cast("int").alias("at"), F.lit(kind).alias("kind"))
    extent, text = F.col("extent"), F.col("text")
    own = event(F.col("i") * 2, 0)
    start, end = event(extent["first"] * 2 - 1, 1), event(extent["last"] * 2 + 1, -1)
    events = (
        F.when(extent["last"].isNull() & extent.isNotNull(), F.array(own, start))
        .when(extent["last"] >= extent["first"], F.array(own, start, end))
        .otherwise(F.array(own))
    )
    by_event = _ordered(by=("at", "kind"))
    t = tokens.withColumn("event", F.explode(events)).withColumns({"at": F.col("event.at"), "kind": F.col("event.kind")})
    t = t.drop("event").withColumn("depth", F.sum("kind").over(_until(by_event))).where("kind >= 0")
    heads = text.isin("def", "async") & ((F.lead("kind").over(by_event) == 1) | (F.lead("kind", 2).over(by_event) == 1))
    t = t.withColumn("header", F.coalesce(heads & (F.col("kind") == 0), F.lit(False))).where("depth > 0 AND NOT header")
    t = t.withColumn("owner", _last(F.col("kind") == 1, extent, _until(_ordered("depth", by=("at", "kind")))))
    t = t.where("kind = 0").withColumn("first", F.col("owner.first"))

    w = _ordered("first")
    bracket, i = F.col("owner.bracket"), F.col("i")
    step = _step(OPENING, CLOSING)
    t = t.withColumn("open", F.sum(F.when(i >= bracket, step)).over(_until(w)))
    t = t.withColumn("over", F.max(F.when((i > bracket) & (F.col("open") <= 0), 1)).over(_until(w)))
    t = t.withColumn("listed", F.coalesce((i > bracket) & F.col("over").isNull(), F.lit(False)))
    t = t.withColumn("inner", F.sum(F.when(F.col("listed"), _step([*OPENING, "<"], [*CLOSING, ">"]))).over(_until(w)))
    t = t.withColumn("piece", F.col("listed") & ~((text == ",") & (F.col("inner") == 0)))
    beside = lambda move: F.coalesce(move("piece").over(w), F.lit(False))
    t = t.withColumns({
        "new_piece": F.col("piece") & ~beside(F.lag) & ~(text.isin(NO_PIECE) & ~beside(F.lead)),
        "reached": F.coalesce(F.max("last_line").over(_before(w)), F.lit(0)),
    })
    fresh = F.greatest(F.lit(0), F.col("last_line") - F.greatest(F.col("line") - 1, F.col("reached")))
    per_function = t.groupBy(*FILE, "copies", "owner").agg(
        F.sum(fresh).alias("nloc"),
        (1 + F.count_if(text.isin(DECISIONS))).alias("ccn"),
        F.count(F.lit(1)).alias("token"),
        F.count_if("new_piece").alias("params"),
    )
    params = F.when(F.col("owner.bracket").isNull(), 1).otherwise(F.col("params"))
    return _function_columns(per_function, params)


def braced_functions(files: DataFrame) -> DataFrame:
    """``files`` (path, content) of all languages with braces to one row of counts per function; null content has none."""
    return _counts(_braced_extents(_tokens(files)))
