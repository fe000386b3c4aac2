"""Scope- and type-aware identifier renaming as a token-table job.

In every method or constructor, parameters and local variables get names
``<bucket><n>`` (bucket from the declared type, see ``functions.text.type_bucket``),
numbered per bucket in declaration order, parameters first; their uses inside
that method are replaced.  There is no parser: the snippet is split into a
lossless token table ``(sid, pos, tok)`` and the grammar facts the rules
need are running sums and last places over it:

* brackets of all kinds nest; a token's *level* is the number of brackets open
  around it, and the tokens directly inside one bracket pair are its siblings,
  whatever stands in the pairs between them;
* every opener has a kind (``for``, parameter list, other parentheses, index;
  block, switch, lambda, class body, array initialiser), and a *statement* is a
  stretch of siblings: it starts after the opener, ``;``, a closed block, class
  or switch, a ``case .. :`` or ``default :`` label (or ``->``), and in a
  parameter list after a comma outside ``< >``; initialisers, lambdas and
  anonymous classes end no statement;
* a method is ``name ( ... ) [throws ...] {`` with ``name`` not a keyword and
  not after ``new`` or ``.``; its span runs from the name to the body's ``}``;
  a body-less (abstract / interface) method ``Type name ( ... ) ;`` spans to
  its ``;`` and has parameters only;
* a parameter name is the last identifier of a parameter, its type the tokens
  before it less annotations (``T... x`` has no type: ``obj``); a receiver
  (``T this``) is none;
* a local is ``[final] [annotations] Type name`` followed by ``= ; , :`` in a
  block, lambda, switch or ``for (``, plus further ``, name`` declarators of its statement;
  locals register in every method whose body holds them, lambda parameters
  and fields in none;
* a repeated name takes a new number, and its last number wins;
* uses: identifiers except a field member ``x.f`` (a method name ``x.m(`` is
  an ordinary identifier), matched on (snippet, name) and the span;
  an outer method's mapping precedes a nested one's.

Broken texts (snippets are line ranges, so cut-off ones are common): brackets
match by nesting level, and balance is judged for each method's span alone.  A
method is renamed if its body closes and no bracket inside its span lacks a
partner or crosses a pair of the other kind; the rest of the text stays.

Execution: snippets are hash partitioned by id once, into as many partitions as
keep a task's text bounded (``TEXT_BYTES`` each), and sorted, so that the rows of an id
stand together; nothing else is sorted or shuffled.  ``mapInArrow`` takes the tokens of some
thousand snippets at a time (``_CHUNK`` tokens, always whole snippets) as columns of numbers: all
facts are running sums and last places within (snippet), (snippet, level) and (snippet, statement).
``rename_identifiers`` takes all steps and splices the texts in that one pass; between replaced
tokens the texts are copied whole.

The steps are operators of their own as well, over tables: ``snippet_tokens`` (with a method's spans
and the declared types among the facts), ``scope_spans``, ``declarations``, ``scope_mappings``,
``replacements``.  Both forms share the functions over columns.  Nothing pairs every row of a snippet with
every method of it: "which methods enclose this token" is answered per nesting level -- at one brace
depth method spans are disjoint, so the last span opened before a
token is the only one that can hold it (``_held``, ``_enclosing``).  Rows are multiplied only by their own
nesting depth.  As in the
reference, catch parameters, try resources, lambda
parameters, record components and fields (also those of anonymous and local
classes) are not declarations here.  Comments are tokens of their own and stay
as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.functions.text import bucket_of
from pairwright.session import shuffle_partitions

# ---------------------------------------------------------------- fixed values
# Java reserved words (plus literals true/false/null and contextual yield).
KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double "
    "else enum extends final finally float for goto if implements import instanceof int interface "
    "long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while true false null yield"
).split()
PRIMITIVES = ("byte", "short", "int", "long", "float", "double", "boolean", "char")
# Text of one partition; the windows of the steps over tables take many times as much memory.
TEXT_BYTES = 1 << 21
# ------------------------------------------------------------------------------

# Lossless tokens: comments, text blocks, literals, identifiers, numbers, whitespace runs, a
# few multi-character operators, then any single character.
TOKEN_RX = (r'''(?s)//[^\n]*+|/\*.*?\*/|"""[^"\\]*+(?:"{0,2}\\.[^"\\]*+|"{1,2}[^"\\][^"\\]*+)*+"""|"[^"\\]*+(?:\\.[^"\\]*+)*+"'''
            r"""|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[\p{L}_$][\p{L}\p{N}_$]*+|\d[\p{L}\p{N}_.]*+|\s++|\.\.\.|->|::|.""")
IDENT_RX = r"^[\p{L}_$][\p{L}\p{N}_$]*$"


def token_table(df: DataFrame, sid: str = "snippet_id", code: str = "code") -> DataFrame:
    """(sid, pos, tok); ``array_join`` of the tokens in pos order gives the code back."""
    return df.select(F.col(sid).alias("sid"),
                     F.posexplode(F.regexp_extract_all(F.col(code), F.lit(TOKEN_RX), 0)).alias("pos", "tok"))


def token_partitions(df: DataFrame, code: str = "code") -> int:
    """Partitions for the token windows of ``df``: one per ``TEXT_BYTES`` of text, at least the session's.

    One pass over the texts; the count is explicit because adaptive coalescing would size partitions
    by the text bytes and leave the (many times larger) token windows to few tasks, which spill.
    """
    size = df.agg(F.sum(F.octet_length(F.col(code)))).first()[0]
    return max(shuffle_partitions(df.sparkSession), -(-(size or 0) // TEXT_BYTES))


def snippet_tokens(df: DataFrame, sid: str = "snippet_id", code: str = "code", partitions: int | None = None, declared: bool = False) -> DataFrame:
    """The token facts of ``df``, dealt and sorted by snippet: its tokens other than space and comments.

    ``declared``: of all tokens' facts give only those that the later steps read, which
    are a method's "(" and, wherever it stands, each name that its snippet declares.

    Columns: sid, pos, tok, c (its class), bd (brace depth before the token; the least of a snippet
    counts as 0), p1, p1pos, n1 (neighbours' classes and position; null at the ends),
    cur_open (the innermost opener), decl (1: declares a local, 0: a parameter, else null), type (of a
    declared name: its statement's declared type, null if there is none); of a method's "(":
    close_pos, body_open (null without a body) and ends (where its span ends), else null; least and
    most depth of a method's span in the snippet (null: it has none).
    """
    t = _dealt(df.select(sid, code), partitions or token_partitions(df, code), sid)
    t = _with_tokens(t.select(F.col(sid).alias("sid"), F.col(code).alias("code")), "code").drop("code")
    own = [f"{name} {kind}" for name, kind in _FACTS.items()]
    return t.mapInArrow(_token_facts(declared), ", ".join([f"sid {t.schema['sid'].dataType.simpleString()}", *own]))


def _dealt(df: DataFrame, partitions: int, sid: str) -> DataFrame:
    """Rows dealt by snippet and sorted, so that those of one id stand together."""
    return df.repartition(partitions, sid).sortWithinPartitions(sid)


def _with_tokens(df: DataFrame, code: str, where: Column | None = None) -> DataFrame:
    """``df`` with a text's tokens as an array (_toks; null where not ``where``) and, if it holds
    more than ASCII, which of them are words (_words)."""
    toks = F.regexp_extract_all(F.col(code), F.lit(TOKEN_RX), 0)
    return (df.withColumn("_toks", toks if where is None else F.when(where, toks))
            .withColumn("_words", F.when(F.col(code).rlike(r"[^\x00-\x7F]"), F.transform("_toks", lambda t: t.rlike(IDENT_RX)))))


# Token classes: whole numbers, which the steps below compare and carry cheaply.
_PUNCT = "{}()[]<>;,:.@?&="
(OPEN, CLOSE, PAREN, UNPAREN, INDEX, UNINDEX, LESS, MORE, SEMI, COMMA, COLON, DOT, AT, ASK, AND, EQUALS,
 ARROW, DOTS, IDENT, RECORD, PRIMITIVE, VOID, FINAL, BOUND, NEW, CLASS, LABEL, SWITCH, FOR, THROWS, WORD) = range(1, 32)
_IDENTS = (IDENT, RECORD)
# Kinds of openers.
K_PAREN, K_HDR, K_FOR, K_INDEX, K_INIT, K_CLASS, K_LAMBDA, K_MADE, K_SWITCH, K_BLOCK = range(1, 11)


# Classes of one-character tokens and of words; all other tokens are 0.
_FIRST = np.zeros(256, np.int8)
for _i, _x in enumerate(_PUNCT):
    _FIRST[ord(_x)] = _i + 1
_LETTER = np.zeros(256, bool)
_LETTER[[ord(_x) for _x in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[ord(_x) for _x in " \t\n\x0b\f\r"]] = True
_WORD_CLASS = dict.fromkeys(KEYWORDS, WORD) | dict.fromkeys(PRIMITIVES, PRIMITIVE) | {
    "record": RECORD, "void": VOID, "final": FINAL, "extends": BOUND, "super": BOUND, "new": NEW, "class": CLASS, "interface": CLASS, "enum": CLASS,
    "case": LABEL, "default": LABEL, "switch": SWITCH, "for": FOR, "throws": THROWS}
_WORDS = pa.array(list(_WORD_CLASS))
_WORD_CLASSES = np.array([*_WORD_CLASS.values(), IDENT], np.int8)  # -1, the last: no word of the list

# The columns of the token facts.
_FACTS = {"pos": "int", "tok": "string", "c": "int", "bd": "int", "p1": "int", "p1pos": "int", "n1": "int", "cur_open": "int",
          "decl": "int", "type": "string", "close_pos": "int", "body_open": "int", "ends": "array<int>", "least": "int", "most": "int"}
# Tokens (or rows) worked on at a time, whole snippets.
_CHUNK = 1 << 17


def _whole_snippets(batches, sid: str, tokens: str | None = None):
    """Record batches of some ``_CHUNK`` tokens (of the column ``tokens``, default: rows), cut between ids only:
    an id whose rows go on in the next batch waits for it."""
    held: list[pa.RecordBatch] = []

    def chunks(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        starts = np.flatnonzero(_changes(t.column(sid)))
        size = np.ones(len(t), np.int64) if tokens is None else _lengths(t.column(tokens))
        upto = np.append((np.cumsum(size) - size)[starts], size.sum())
        cuts = [0]
        while cuts[-1] < len(starts):  # at least one id, and the next ones that fit
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, upto[cuts[-1]] + _CHUNK, "right")) - 1))
        ends = np.append(starts, len(t))
        for lo, hi in zip(cuts, cuts[1:]):
            yield t.slice(ends[lo], ends[hi] - ends[lo]).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        starts = np.flatnonzero(_changes(b.column(sid)))
        if held and held[-1].column(sid)[-1].as_py() != b.column(sid)[0].as_py():
            yield from chunks(held)
            held = []
        if starts[-1] > 0:
            yield from chunks([*held, b.slice(0, starts[-1])])
            held = []
        held.append(b.slice(starts[-1]))
    if held:
        yield from chunks(held)


def _lengths(lists) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def _classes(toks: pa.Array, words: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token and whether it is neither space nor comment; ``words``: which tokens are
    words, needed for those that do not begin with an ASCII character."""
    kind = np.int64 if pa.types.is_large_string(toks.type) else np.int32
    _, ends, data = toks.buffers()
    ends = np.frombuffer(ends, kind)[toks.offset:toks.offset + len(toks) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    first, size = data[ends[:-1]], np.diff(ends)
    second = data[np.minimum(ends[:-1] + 1, len(data) - 1)]
    word = _LETTER[first]
    if words is not None:
        word = np.where(first < 128, word, words)
    c = np.where(size == 1, _FIRST[first], 0).astype(np.int8)
    at = np.flatnonzero(word)
    c[at] = _WORD_CLASSES[pc.fill_null(pc.index_in(toks.take(pa.array(at)), value_set=_WORDS.cast(toks.type)), -1).to_numpy()]
    c[(first == ord("-")) & (size == 2)] = ARROW
    c[(first == ord(".")) & (size == 3)] = DOTS
    return c, ~(_SPACE[first] | ((first == ord("/")) & (size > 1) & ((second == ord("/")) | (second == ord("*")))))


class _Snippets:
    """The tokens of a batch of whole snippets and their facts.

    ``toks``: all tokens, ``offsets``: where each row's begin; of those that are neither space nor comment,
    in text order: at (place in toks), tok, g (the id's number in the batch), pos, c and the facts ``f``.
    ``known``: which ids are not null; ``repeated``: whether ids share tokens' positions.
    """

    def __init__(self, sid, lists, words):
        size = _lengths(lists)
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        self.toks = lists.flatten()
        self.changes = _changes(sid)
        flags = None
        if words.null_count < len(words):
            flags = np.zeros(len(self.toks), bool)
            flags[np.repeat(words.is_valid().to_numpy(zero_copy_only=False), size)] = words.flatten().to_numpy(zero_copy_only=False)
        c, kept = _classes(self.toks, flags)
        number = np.cumsum(self.changes) - 1
        self.at = np.flatnonzero(kept)
        row = np.repeat(np.arange(len(size)), size)[self.at]
        self.g, self.pos, self.c = number[row].astype(np.int32), (self.at - self.offsets[row]).astype(np.int32), c[self.at]
        # rows that repeat a snippet's id are one snippet, as in every join on it
        self.repeated = bool(((np.diff(self.pos) <= 0) & (np.diff(self.g) == 0)).any())
        if self.repeated:
            order = np.lexsort((self.pos, self.g))
            self.at, self.g, self.pos, self.c = (x[order] for x in (self.at, self.g, self.pos, self.c))
        self.known = sid.is_valid().to_numpy(zero_copy_only=False)[self.changes]
        self.f = _sequence_facts(self.g, self.pos, self.c, self.repeated)
        self.tok = self.toks.take(pa.array(self.at))

    def types(self) -> pa.Array:
        """The texts of the declared types, which ``f["type_of"]`` counts."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(self.f["type_ends"].astype(np.int32)), self.tok.take(pa.array(self.f["type_at"]))), "")

    def declared(self) -> np.ndarray:
        """Which tokens are names that their snippet declares."""
        named, words = np.flatnonzero((self.f["decl"] >= 0) & (self.f["type_of"] >= 0)), np.flatnonzero(_in(self.c, *_IDENTS))
        names = self.tok.take(pa.array(named)).dictionary_encode()
        of = pc.fill_null(pc.index_in(self.tok.take(pa.array(words)), value_set=names.dictionary), -1).to_numpy()
        out = np.zeros(len(self.g), bool)
        out[words] = np.isin(_key(self.g[words], of), _key(self.g[named], names.indices.to_numpy()))
        return out

    def scopes(self) -> dict:
        return _scopes(self.g, self.pos, self.c, self.f, self.known)


def _token_facts(declared: bool):
    """A function from batches of (sid, _toks, _words) to the facts of their tokens."""
    def run(batches):
        for b in _whole_snippets(batches, "sid", "_toks"):
            t = _Snippets(*(b.column(x) for x in ("sid", "_toks", "_words")))
            if len(t.g):
                yield _fact_rows(b.column("sid").filter(pa.array(t.changes)), t, declared)
    return run


def _fact_rows(ids: pa.Array, t: _Snippets, declared: bool) -> pa.RecordBatch:
    f, n, scopes = t.f, len(t.g), t.scopes()
    per_head = np.bincount(scopes["head"], minlength=n)
    heads = per_head > 0
    body = np.full(n, -1, np.int32)
    body[scopes["head"]] = scopes["body_open"]
    ends = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_head)]).astype(np.int32)),
                                    pa.array(scopes["hi"][np.argsort(scopes["head"], kind="stable")].astype(np.int32)), mask=pa.array(~heads))
    least, most = np.full(len(ids), np.iinfo(np.int32).max), np.full(len(ids), -1)
    np.minimum.at(least, scopes["g"], scopes["depth"])
    np.maximum.at(most, scopes["g"], scopes["depth"])
    at = np.flatnonzero(heads | t.declared()) if declared else np.arange(n)
    if t.repeated:  # tokens at one position follow their statements
        at = at[np.lexsort((f["stmt"][at], t.g[at]))]

    def whole(x, there=None):
        return pa.array(x[at].astype(np.int32), mask=None if there is None else ~there[at])

    got = {"pos": whole(t.pos), "tok": t.tok.take(pa.array(at)), "c": whole(t.c), "bd": whole(f["bd"]), "p1": whole(f["p1"], f["p1at"] >= 0),
           "p1pos": whole(f["p1pos"], f["p1at"] >= 0), "n1": whole(f["n1"], f["n1at"] >= 0), "cur_open": whole(f["cur_open"], f["cur_open"] >= 0),
           "decl": whole(f["decl"], f["decl"] >= 0), "type": t.types().take(pa.array(f["type_of"][at], mask=f["type_of"][at] < 0)),
           "close_pos": whole(f["close_pos"], heads), "body_open": whole(body, heads & (body >= 0)), "ends": ends.take(pa.array(at)),
           "least": whole(least[t.g], most[t.g] >= 0), "most": whole(most[t.g], most[t.g] >= 0)}
    return pa.RecordBatch.from_arrays([ids.take(pa.array(t.g[at])), *got.values()], ["sid", *got])


def _changes(sid) -> np.ndarray:
    """Where a snippet's tokens begin."""
    if isinstance(sid, pa.ChunkedArray):
        sid = sid.combine_chunks()
    known = sid.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[True], known[1:] != known[:-1]])


class _Runs:
    """Rows that stand together, by key: sums over, and places of, the rows of a run before each row (-1: none)."""

    def __init__(self, *keys: np.ndarray):
        n = len(keys[0])
        self.at = np.arange(n, dtype=np.int32)
        self.begins = np.ones(n, bool)
        self.begins[1:] = False
        for k in keys:
            self.begins[1:] |= k[1:] != k[:-1]
        self.start = np.maximum.accumulate(np.where(self.begins, self.at, np.int32(0)))

    def upto(self, mask: np.ndarray) -> np.ndarray:
        """Place of the last row with ``mask``, the row itself included."""
        last = np.maximum.accumulate(np.where(mask, self.at, np.int32(-1)))
        return np.where(last >= self.start, last, np.int32(-1))

    def before(self, mask: np.ndarray) -> np.ndarray:
        last = np.empty_like(self.at)
        last[:1] = -1
        np.maximum.accumulate(np.where(mask, self.at, np.int32(-1))[:-1], out=last[1:])
        return np.where(last >= self.start, last, np.int32(-1))

    def sum_before(self, x: np.ndarray) -> np.ndarray:
        total = np.cumsum(x, dtype=np.int32) - x
        return total - total[self.start]

    def shift(self, k: int) -> np.ndarray:
        """Place of the row k further (before, if negative)."""
        to = self.at + np.int32(k)
        inside = (to >= 0) & (to < len(to))
        to = np.where(inside, to, np.int32(0))
        return np.where(inside & (self.start[to] == self.start), to, np.int32(-1))

    def least(self, x: np.ndarray) -> np.ndarray:
        """The least value of each row's run."""
        heads = np.flatnonzero(self.begins)
        return np.repeat(np.minimum.reduceat(x, heads), np.diff(np.append(heads, len(x)))) if len(x) else x


def _get(x: np.ndarray, at: np.ndarray, none=0) -> np.ndarray:
    """x at the places, ``none`` where there is none (classes and kinds begin at 1)."""
    return np.where(at >= 0, x[at], x.dtype.type(none))


# Membership of a class or kind is a look-up; 0 stands for none.
def _in(x: np.ndarray, *kinds: int) -> np.ndarray:
    table = np.zeros(32, bool)
    table[list(kinds)] = True
    return table[x]


def _by(*keys: np.ndarray) -> np.ndarray:
    """Order by the keys; rows equal in all of them stay in text order."""
    return np.lexsort(keys[::-1])


def _together(x: np.ndarray) -> np.ndarray:
    """Order that puts equal x together, each in text order: what is equal in x of one snippet is then one stretch."""
    if len(x) and -(1 << 15) <= x.min() and x.max() < 1 << 15:
        x = x.astype(np.int16)  # sorted by digits
    return np.argsort(x, kind="stable")


def _sequence_facts(g: np.ndarray, pos: np.ndarray, c: np.ndarray, repeated: bool) -> dict:
    """Facts of the tokens of snippets ``g`` (in text order); places and positions are -1 where there is none.
    ``repeated``: some tokens of a snippet share their position."""
    f = _depths(g, pos, c)
    f |= _statements(g, pos, c, f)
    f |= _declared(g, pos, c, f, _by(g, f["stmt"]) if repeated else f["by_level"])
    return f | _brackets(g, pos, c, f, repeated)


def _depths(g, pos, c) -> dict:
    """Depths, level, neighbours, annotations of the tokens."""
    w = _Runs(g)

    def depth(openers, closers):
        step = np.zeros(32, np.int8)
        step[openers], step[closers] = 1, -1
        return w.sum_before(step[c])

    bd = depth([OPEN], [CLOSE])
    f = {"pd": depth([PAREN], [UNPAREN]), "angles": depth([LESS], [MORE]), "p1at": w.shift(-1), "n1at": w.shift(1)}
    # a closer is its opener's sibling
    f["lvl"] = depth([OPEN, PAREN, INDEX], [CLOSE, UNPAREN, UNINDEX]) - _in(c, CLOSE, UNPAREN, UNINDEX)
    p1, p2, n1, n2 = _get(c, f["p1at"]), _get(c, w.shift(-2)), _get(c, f["n1at"]), _get(c, w.shift(2))
    ident = _in(c, *_IDENTS)
    # "@", its (qualified) name and its parentheses; anything else ends the annotation
    part_ends = ~(_in(c, DOT, PAREN, UNPAREN) | (ident & _in(p1, AT, DOT)))
    # "new" before "(", with nothing but a type between
    typed = _in(c, *_IDENTS, PRIMITIVE, DOT, COMMA, ASK, AND, LESS, MORE, INDEX, UNINDEX, AT, BOUND)
    # a class word since the last ; { or }
    header = ((c == CLASS) & (p1 != DOT)) | ((c == RECORD) & _in(n1, *_IDENTS) & _in(n2, PAREN, LESS))
    # "(" after a non-keyword identifier not preceded by new or "." may open a parameter list;
    # a body-less method needs a declaration before its name (a type or void), which a call never has
    hdr = (c == PAREN) & _in(p1, *_IDENTS) & ~_in(p2, NEW, DOT, AT, RECORD)
    return f | {"bd": bd - np.minimum(w.least(bd), 0), "p1": p1, "n1": n1, "n2": n2, "p1pos": _get(pos, f["p1at"]), "n1pos": _get(pos, f["n1at"]),
                "lead": _get(c, w.before(c != OPEN)), "ann": _get(c, w.upto((c == AT) | part_ends)) == AT,
                "made": _get(c, w.before(~typed)) == NEW, "header": _get(header, w.before(header | _in(c, SEMI, OPEN, CLOSE)), False),
                "hdr": hdr, "decl_like": hdr & _in(p2, *_IDENTS, PRIMITIVE, VOID, MORE, UNINDEX)}


def _kinds(g, c, f, order) -> np.ndarray:
    """The kind of every opener (0: none); for "{" after ")" the parentheses before it tell."""
    p1, after = f["p1"], np.select([f["made"], f["p1"] == SWITCH], [np.int8(K_MADE), np.int8(K_SWITCH)], np.int8(K_BLOCK))
    paren = np.empty_like(after)
    paren[order] = _get(after[order], _Runs(g[order], f["lvl"][order]).before(c[order] == PAREN))
    kind = np.zeros(len(c), np.int8)
    kind[c == INDEX] = K_INDEX
    at = np.flatnonzero(c == PAREN)
    kind[at] = np.select([p1[at] == FOR, f["hdr"][at]], [K_FOR, K_HDR], K_PAREN)
    at = np.flatnonzero(c == OPEN)
    kind[at] = np.select([_in(f["lead"][at], EQUALS, UNINDEX, COMMA, PAREN), f["header"][at], p1[at] == ARROW, p1[at] == UNPAREN],
                         [K_INIT, K_CLASS, K_LAMBDA, paren[at]], K_BLOCK)
    return kind


def _statements(g, pos, c, f) -> dict:
    """cur_open (-1: none) and kind (the innermost opener and its kind), outer (its angles), stmt (position of the
    boundary before; levels above all brackets, which have none, count down from -1) and by_level (an order of the
    tokens by level, in which those of a statement stand together)."""
    # an opener goes to the level inside it as well, as the first boundary there
    at = np.repeat(np.arange(len(c), dtype=np.int32), 1 + _in(c, OPEN, PAREN, INDEX))
    mark = np.concatenate([[False], at[1:] == at[:-1]]) if len(at) else np.zeros(0, bool)
    lvl = f["lvl"][at] + mark
    order = _together(lvl)
    at, mark, lvl = at[order], mark[order], lvl[order]
    tokens = at[~mark]
    own = _kinds(g, c, f, tokens)[at]
    c, angles, pos = c[at], f["angles"][at], pos[at]
    w = _Runs(g[at], lvl)
    closed = _get(own, w.before(~mark & (own > 0)))
    label = _get(np.where(mark, np.int8(0), c), w.before(mark | _in(c, LABEL, SEMI, CLOSE, COLON, ARROW)))
    opener = w.upto(mark)
    kind, outer = _get(own, opener), _get(angles, opener)
    boundary = (mark | (c == SEMI) | ((c == CLOSE) & _in(closed, K_BLOCK, K_CLASS, K_SWITCH))
                | (_in(c, COLON, ARROW) & (label == LABEL))
                | ((c == COMMA) & (kind == K_HDR) & (angles == outer)))
    last = w.before(boundary)
    got = {"cur_open": _get(pos, opener, -1), "kind": kind, "stmt": np.where(last >= 0, pos[last], lvl - 1)}
    for x, y in got.items():
        got[x] = np.empty(len(tokens), y.dtype)
        got[x][tokens] = y[~mark]
    return got | {"by_level": tokens}


def _declared(g, pos, c, f, order) -> dict:
    """decl (-1: none), and of the names that have a declared type its number (type_of, else -1): type t are the tokens
    type_at[type_ends[t]:type_ends[t + 1]].  ``order``: the tokens by statement."""
    n, g, pos, c, stmt = len(c), g[order], pos[order], c[order], f["stmt"][order]
    p1, n1, n2, kind, angles = (f[x][order] for x in ("p1", "n1", "n2", "kind", "angles"))
    w = _Runs(g, stmt)
    ident = _in(c, *_IDENTS)
    # only an annotation has parentheses before a declared name
    body = ~f["ann"][order] & ~_in(c, FINAL, PAREN, UNPAREN)
    typed = _in(c, *_IDENTS, PRIMITIVE, DOT, COMMA, ASK, AND, LESS, MORE, INDEX, UNINDEX, DOTS, BOUND, FINAL, AT, PAREN, UNPAREN)
    first = w.upto(body & (w.sum_before(body) == 0))
    typed_first = _get(ident | (c == PRIMITIVE), first, False)
    type_end = _in(p1, *_IDENTS, PRIMITIVE, MORE, UNINDEX)
    flat = angles == angles[w.start]
    in_locals = _in(kind, K_BLOCK, K_LAMBDA, K_SWITCH, K_FOR) & ident
    # a C-style array declarator "name[]" keeps the declared (element) type
    array = (n1 == INDEX) & (n2 == UNINDEX)
    primary = in_locals & (_in(n1, EQUALS, SEMI, COMMA, COLON) | array) & type_end & flat & (w.before(~typed) < 0) & typed_first
    # generic arguments are not followed by "=" or ";", only their commas need the angle brackets counted
    more = in_locals & (p1 == COMMA) & (_in(n1, EQUALS, SEMI) | (((n1 == COMMA) | array) & flat))
    param = (kind == K_HDR) & ident & (_in(n1, COMMA, UNPAREN) | array) & (type_end | (p1 == DOTS)) & flat
    none = np.iinfo(np.int32).max
    name = w.least(np.where(primary | param, pos, np.int32(none)))
    begun = w.sum_before(primary) > 0
    decl = np.select([np.where(begun, more, primary), param], [np.int8(1), np.int8(0)], np.int8(-1))
    is_type = body & (pos < name) & (name < none)
    # one type for each statement that has one
    number = np.cumsum(w.begins, dtype=np.int32) - 1
    of = np.flatnonzero(is_type)
    starts = np.flatnonzero(np.diff(number[of], prepend=-1)) if len(of) else of
    type_no = np.full(number[-1] + 1 if n else 0, -1, np.int32)
    type_no[number[of[starts]]] = np.arange(len(starts))
    got = {"decl": decl, "type_of": np.where(decl >= 0, type_no[number], np.int32(-1))}
    for x, y in got.items():
        got[x] = np.empty(n, y.dtype)
        got[x][order] = y
    return got | {"type_at": order[of], "type_ends": np.append(starts, len(of))}


def _brackets(g, pos, c, f, repeated) -> dict:
    """Parentheses and braces that close, with what closes them (close_*) and how many
    broken ones stand up to them (faults) and up to their closer (close_faults); close_pos is -1 for all other tokens.

    At one depth openers and closers of a kind alternate in any text, so an
    opener's partner is the next bracket of its depth.  A
    bracket is broken if it has no partner or if brackets of the other kind do not balance between the two.
    """
    names = ("close_pos", "close_n1", "close_n1pos", "close_nb", "faults", "close_faults")
    out = {x: np.full(len(c), -1, np.int32) for x in names}
    at = np.flatnonzero(_in(c, OPEN, CLOSE, PAREN, UNPAREN))
    if not len(at):
        return out
    if repeated:
        at = at[_by(g[at], pos[at], f["stmt"][at])]
    n1, n1pos = (np.where(f["n1at"][at] >= 0, f[x][at], -1) for x in ("n1", "n1pos"))
    g, pos, c, bd, pd = g[at], pos[at], c[at], f["bd"][at], f["pd"][at]
    opens, brace = _in(c, PAREN, OPEN), _in(c, OPEN, CLOSE)
    own, other = np.where(brace, bd, pd), np.where(brace, pd, bd)
    by_pos = _Runs(g)
    # the bracket after a ")" is its method body when it is "{" (a throws clause holds none)
    follows = by_pos.shift(1)
    nb = np.where((follows >= 0) & (c[follows] == OPEN), pos[follows], -1)
    lvl = 2 * np.where(opens, own, own - 1) + brace
    order = _together(lvl)
    level = _Runs(g[order], lvl[order])

    def partner(k):
        to, got = level.shift(k), np.empty_like(order)
        got[order] = np.where(to >= 0, order[to], -1)
        return got

    ahead, back = partner(1), partner(-1)
    closes = (ahead >= 0) & ~opens[ahead]
    whole = np.where(opens, closes & (other[ahead] == other), (back >= 0) & opens[back] & (other[back] == other))
    faults = by_pos.sum_before(~whole) + ~whole
    mine = np.flatnonzero(opens & closes)
    to = ahead[mine]
    for x, y in zip(names, (pos[to], n1[to], n1pos[to], nb[to], faults[mine], faults[to]), strict=True):
        out[x][at[mine]] = y
    return out


# ---------------------------------------------------------------- the steps over whole snippets
def _key(g: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One number for a snippet's number and a position or place (-1: none) in it."""
    return (g.astype(np.int64) << 32) + x


def _matches(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of equal numbers, as an inner join gives them."""
    order = np.argsort(right, kind="stable")
    lo, hi = (np.searchsorted(right[order], left, side) for side in ("left", "right"))
    return _spread(hi - lo, lo, lambda at: order[at])


def _spread(count, lo, get):
    """(row, get(lo + i)) for i below each row's count."""
    row = np.repeat(np.arange(len(count)), count)
    return row, get(np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + lo[row])


def _scopes(g, pos, c, f, known) -> dict:
    """Methods whose own span is whole: g, head (place of the "("), scope, hi, depth, popen, body_open (-1: no body)."""
    close_n1, nb = f["close_n1"], f["close_nb"]
    head = np.flatnonzero((c == PAREN) & f["hdr"] & (f["close_pos"] >= 0) & (close_n1 >= 0))
    with_body = _in(close_n1[head], OPEN, THROWS) & (nb[head] >= 0)
    # abstract / interface methods: the span ends at the ";" and there is no body
    no_body = f["decl_like"][head] & (close_n1[head] == SEMI)
    body = np.flatnonzero((c == OPEN) & (f["close_pos"] >= 0))
    mine = head[with_body & known[g[head]]]
    i, b = _matches(_key(g[mine], nb[mine]), _key(g[body], pos[body]))
    mine, b = mine[i], body[b]
    bare = head[no_body]
    heads = np.concatenate([mine, bare])
    hi = np.concatenate([f["close_pos"][b], f["close_n1pos"][bare]])
    # a pair is whole itself, so equal counts at both ends mean that all brackets between are
    faults, upto = f["faults"][heads], np.concatenate([f["close_faults"][b], f["close_faults"][bare]])
    whole = (faults == upto) & (faults == f["close_faults"][heads])
    heads, hi, body_open = heads[whole], hi[whole], np.concatenate([pos[b], np.full(len(bare), -1, np.int32)])[whole]
    return {"g": g[heads], "head": heads, "scope": f["p1pos"][heads], "hi": hi, "depth": f["bd"][heads], "popen": pos[heads], "body_open": body_open}


def _held(key, pos, top, m_key, lvl, start, end) -> tuple[np.ndarray, np.ndarray]:
    """For each row (key, pos) and each nesting level up to ``top`` the marker (m_key, lvl) opened last before it
    (start -1 is before all), if the row lies before the marker's end: (places of rows, places of markers)."""
    order = np.lexsort((start, lvl, m_key))
    mk, ml, ms = m_key[order], lvl[order], start[order].astype(np.int64) + 1
    first = np.flatnonzero(np.concatenate([[True], (mk[1:] != mk[:-1]) | (ml[1:] != ml[:-1])])) if len(mk) else order
    gk, gl = mk[first], ml[first]
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(mk))))
    lo, hi = (np.searchsorted(gk, key, side) for side in ("left", "right"))
    row, of = _spread(hi - lo, lo, lambda at: at)
    reached = gl[of] <= top[row]
    row, of = row[reached], of[reached]
    at = np.searchsorted((group << 32) + ms, (of << 32) + pos[row] + 1, "right") - 1
    inside = (at >= 0) & (group[at] == of) if len(group) else np.zeros(0, bool)
    row, at = row[inside], order[at[inside]]
    inside = pos[row] <= end[at]
    return row[inside], at[inside]


def _declare(names: dict, scopes: dict, known: np.ndarray) -> tuple[np.ndarray, dict]:
    """Parameters and locals by scope: (places of names, {g, scope, is_local, pos})."""
    param, local = (np.flatnonzero(names["decl"] == x) for x in (0, 1))
    own = param[known[names["g"][param]]]
    i, s = _matches(_key(names["g"][own], names["cur_open"][own]), _key(scopes["g"], scopes["popen"]))
    # registered in every method whose body holds the declaration
    j, t = _held(names["g"][local], names["pos"][local], names["bd"][local] - 1, scopes["g"], scopes["depth"], scopes["body_open"], scopes["hi"])
    at, scope = np.concatenate([own[i], local[j]]), np.concatenate([s, t])
    return at, {"g": names["g"][at], "scope": scopes["scope"][scope], "is_local": names["decl"][at], "pos": names["pos"][at]}


def _number(decls: dict, bucket: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The declarations that name a scope's variables, the last of a name, and their numbers in the bucket."""
    of = _key(decls["g"], decls["scope"])
    order = np.lexsort((decls["pos"], decls["is_local"], bucket, of))
    w = _Runs(of[order], bucket[order])
    number = np.empty(len(order), np.int32)
    number[order] = w.at - w.start + 1
    order = np.lexsort((decls["pos"], decls["is_local"], name, of))
    last = np.ones(len(order), bool)
    last[:-1] = (of[order][1:] != of[order][:-1]) | (name[order][1:] != name[order][:-1])
    return order[last], number[order[last]]


def _replace(uses: dict, maps: dict, scopes: dict, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Uses inside a scope that maps their name, and by which mapping; the outermost scope wins.
    ``name``: numbers of the names (-1: no mapping's name)."""
    mine = np.flatnonzero(known[maps["g"]])
    i, s = _matches(_key(maps["g"][mine], maps["scope"][mine]), _key(scopes["g"], scopes["scope"]))
    mine = mine[i]
    row, at = _held(_key(uses["g"], uses["name"]), uses["pos"], uses["bd"], _key(maps["g"][mine], maps["name"][mine]),
                    scopes["depth"][s], scopes["scope"][s], scopes["hi"][s])
    order = np.lexsort((scopes["depth"][s[at]], _key(uses["g"], uses["pos"])[row]))
    row, at = row[order], at[order]
    first = np.flatnonzero(_Runs(_key(uses["g"], uses["pos"])[row]).begins) if len(row) else row
    return row[first], mine[at[first]]


def scope_spans(sig: DataFrame, partitions: int | None = None) -> DataFrame:
    """methods/constructors whose own span is whole
    (sid, scope, lo, hi, depth, popen, pclose, body_open).

    The tokens' facts hold them (``_scopes``), so nothing is dealt; ``partitions`` is as in the other steps.
    """
    at = F.col("p1pos")
    return (sig.filter("ends is not null").withColumn("hi", F.explode("ends"))
            .select("sid", at.alias("scope"), at.alias("lo"), "hi", F.col("bd").alias("depth"), F.col("pos").alias("popen"),
                    F.col("close_pos").alias("pclose"), "body_open"))


def _enclosing(rows: DataFrame, markers: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """For each row (keys, pos, bd, least, most, payload...) and each nesting level from ``least`` to ``most`` up
    to its own brace depth the marker (keys, lvl, pos, end, payload...) of that level opened last before
    it, kept when the row lies before the marker's end.

    Both sides are dealt by snippet into ``partitions`` (default: the session's) before the
    rows are multiplied by their levels, so each row is shuffled once.
    """
    u = rows.withColumn("_kind", F.lit(1)).unionByName(markers.withColumn("_kind", F.lit(0)), allowMissingColumns=True) \
        .repartition(partitions or shuffle_partitions(rows.sparkSession), "sid")
    most = F.least("most", "bd")
    levels = F.when(F.col("_kind") == 0, F.array(F.col("lvl").cast("int"))).when(F.col("least") <= most, F.sequence("least", most))
    u = u.withColumn("lvl", F.explode(levels)).drop("least", "most")
    w = (Window.partitionBy(*keys, "lvl").orderBy("pos", "_kind")
         .rowsBetween(Window.unboundedPreceding, 0))
    cols = [c for c in markers.columns if c not in (*keys, "lvl", "pos")]
    carried = u.withColumn("_m", F.last(F.when(F.col("_kind") == 0, F.struct(*cols)), True).over(w))
    return (carried.filter((F.col("_kind") == 1) & F.col("_m").isNotNull() & (F.col("pos") <= F.col("_m.end")))
            .select(*(c for c in rows.columns if c not in ("least", "most")), "lvl", "_m.*"))


def declarations(sig: DataFrame, scopes: DataFrame, partitions: int | None = None) -> DataFrame:
    """(sid, scope, name, bucket, is_local, pos) for parameters and locals.

    Declared names and scopes are dealt by snippet and matched a snippet at a time (``_declare``)."""
    names = sig.filter("decl is not null and type is not null").select("sid", "pos", "bd", "cur_open", "decl", F.col("tok").alias("name"), "type")
    heads = scopes.select("sid", "scope", "depth", "popen", "body_open", "hi")
    u = _dealt(names.unionByName(heads, allowMissingColumns=True), partitions or shuffle_partitions(sig.sparkSession), "sid")
    kind = sig.schema["sid"].dataType.simpleString()
    return u.mapInArrow(_declared_rows, f"sid {kind}, scope int, name string, bucket string, is_local int, pos int")


def _declared_rows(batches):
    """Batches of names and scopes to the names' declarations."""
    for b in _whole_snippets(batches, "sid"):
        changes = _changes(b.column("sid"))
        cols = {x: pc.fill_null(b.column(x), -1).to_numpy() for x in ("pos", "bd", "cur_open", "decl", "scope", "depth", "popen", "body_open", "hi")}
        cols["g"] = (np.cumsum(changes) - 1).astype(np.int32)
        named = cols["decl"] >= 0
        names, scopes = ({x: y[rows] for x, y in cols.items()} for rows in (named, ~named))
        at, got = _declare(names, scopes, b.column("sid").is_valid().to_numpy(zero_copy_only=False)[changes])
        rows = pa.array(np.flatnonzero(named)[at])
        sid, name, types = (b.column(x).take(rows) for x in ("sid", "name", "type"))
        scope, is_local, pos = (pa.array(got[x].astype(np.int32)) for x in ("scope", "is_local", "pos"))
        yield pa.RecordBatch.from_arrays([sid, scope, name, _buckets(types), is_local, pos], ["sid", "scope", "name", "bucket", "is_local", "pos"])


def _buckets(types: pa.Array) -> pa.Array:
    types = types.dictionary_encode()
    return pa.array([bucket_of(x) for x in types.dictionary.to_pylist()], pa.string()).take(types.indices)


def scope_mappings(decls: DataFrame, partitions: int | None = None) -> DataFrame:
    """I4: name -> ``<bucket><n>`` per scope; the last declaration of a name wins.

    ``partitions``: deal the declarations by snippet into so many, once for both steps."""
    if partitions:
        decls = decls.repartition(partitions, "sid")
    w = Window.partitionBy("sid", "scope", "bucket").orderBy("is_local", "pos")
    numbered = decls.withColumn("new_name", F.concat("bucket", F.row_number().over(w).cast("string")))
    return (numbered.groupBy("sid", "scope", "name")
            .agg(F.max_by("new_name", F.struct("is_local", "pos")).alias("new_name")))


def replacements(sig: DataFrame, scopes: DataFrame, mappings: DataFrame, partitions: int | None = None) -> DataFrame:
    """(sid, pos, new_name) for uses inside a mapped scope; the outermost wins."""
    spans = mappings.join(scopes.select("sid", "scope", "lo", "hi", "depth"), ["sid", "scope"])
    # a field member "x.f" is skipped; a method name "x.m(" is an ordinary identifier
    member = (F.coalesce("p1", F.lit(0)) == DOT) & (F.coalesce("n1", F.lit(0)) != PAREN)
    uses = (sig.filter(F.col("c").isin(*_IDENTS) & ~member)
            .select("sid", "pos", "bd", F.col("tok").alias("name"), "least", "most"))
    markers = spans.select("sid", "name", F.col("depth").alias("lvl"), F.col("lo").alias("pos"),
                           F.col("hi").alias("end"), "new_name")
    hits = _enclosing(uses, markers, ["sid", "name"], partitions=partitions)
    return hits.groupBy("sid", "pos").agg(F.min_by("new_name", F.col("lvl")).alias("new_name"))


def _renames(t: _Snippets) -> tuple[np.ndarray, pa.Array]:
    """All steps over whole snippets: the tokens to replace (in text order) and their new names."""
    f = t.f
    named = np.flatnonzero((f["decl"] >= 0) & (f["type_of"] >= 0))
    names = {x: f[x][named] for x in ("decl", "bd", "cur_open")} | {"g": t.g[named], "pos": t.pos[named]}
    scopes = t.scopes()
    at, decls = _declare(names, scopes, t.known)
    tok = t.tok.take(pa.array(named[at])).dictionary_encode()
    bucket = _buckets(t.types().take(pa.array(f["type_of"][named[at]])))
    name = tok.indices.to_numpy()
    last, number = _number(decls, bucket.dictionary_encode().indices.to_numpy(), name)
    new_name = pc.binary_join_element_wise(bucket.take(pa.array(last)), pa.array(number).cast(pa.string()), "")
    maps = {"g": decls["g"][last], "scope": decls["scope"][last], "name": name[last]}
    # a field member "x.f" is skipped; a method name "x.m(" is an ordinary identifier
    used = np.flatnonzero(_in(t.c, *_IDENTS) & ~((f["p1"] == DOT) & (f["n1"] != PAREN)))
    of = pc.fill_null(pc.index_in(t.tok.take(pa.array(used)), value_set=tok.dictionary), -1).to_numpy()
    used, of = used[of >= 0], of[of >= 0]
    row, by = _replace({"g": t.g[used], "pos": t.pos[used], "bd": f["bd"][used], "name": of}, maps, scopes, t.known)
    return used[row], new_name.take(pa.array(by))


_SHARED = pa.list_(pa.struct([("pos", pa.int32()), ("new_name", pa.string())]))


def _renamed_batches(sid: str, code: str, columns: list[str]):
    """A function from batches of rows with their tokens to the ``columns``, renamed (whether any token was)
    and _m (the replacements, of rows that share their id with others)."""
    def run(batches):
        for b in _whole_snippets(batches, sid, "_toks"):
            t = _Snippets(b.column(sid), b.column("_toks"), b.column("_words"))
            at, new_name = _renames(t)
            row_of = np.cumsum(t.changes) - 1
            hit = np.bincount(t.g[at], minlength=len(t.known)) > 0
            alone = np.bincount(row_of, minlength=len(t.known)) == 1
            mine = alone[t.g[at]]
            put = np.zeros(len(t.toks), bool)
            put[t.at[at[mine]]] = True
            toks = pc.replace_with_mask(t.toks, pa.array(put), new_name.filter(pa.array(mine)).cast(t.toks.type))
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(t.offsets.astype(np.int32)), toks), "")
            shared = pa.nulls(b.num_rows, _SHARED)
            if not mine.all():
                by_id: dict[int, list] = {}
                for g, pos, x in zip(t.g[at[~mine]].tolist(), t.pos[at[~mine]].tolist(), new_name.filter(pa.array(~mine)).to_pylist()):
                    by_id.setdefault(g, []).append({"pos": pos, "new_name": x})
                shared = pa.array([by_id.get(g) for g in row_of.tolist()], _SHARED)
            got = {c: b.column(c) for c in columns} | {code: pc.if_else(pa.array((hit & alone)[row_of]), text, b.column(code))}
            yield pa.RecordBatch.from_arrays([*got.values(), pa.array(hit[row_of]), shared], [*got, "renamed", "_m"])
    return run


def rename_identifiers(df: DataFrame, sid: str = "snippet_id", code: str = "code", dealt: bool = False) -> DataFrame:
    """``df`` with ``code`` renamed and a ``renamed`` flag.

    ``dealt``: rows of one id stand together already (``deal_snippets``).  The texts are
    tokenised once and pass the steps above a batch of whole snippets at a time; the
    stretches between replaced tokens are copied whole, so the time is linear in the tokens.
    """
    df = df.drop("renamed")
    if not dealt:
        df = deal_snippets(df, sid, code)
    # A text without "(" and "{" holds no method; it skips the job.
    maybe = (F.instr(F.col(code), "(") > 0) & (F.instr(F.col(code), "{") > 0)
    columns = [sid, *(c for c in df.columns if c != sid)]
    t = _with_tokens(df.select(*columns), code, maybe)
    fields = [T.StructField(c, df.schema[c].dataType) for c in columns]
    shared = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("new_name", T.StringType())]))
    schema = T.StructType([*fields, T.StructField("renamed", T.BooleanType()), T.StructField("_m", shared)])
    out = t.mapInArrow(_renamed_batches(sid, code, columns), schema)
    return out.withColumn(code, F.when(F.col("_m").isNotNull(), _spliced(code)).otherwise(F.col(code))).drop("_m")


def deal_snippets(df: DataFrame, sid: str = "snippet_id", code: str = "code") -> DataFrame:
    """``df`` dealt by id once, into as many parts as its texts take, and sorted."""
    return _dealt(df, token_partitions(df, code), sid)


def _spliced(code: str) -> Column:
    """A text whose row shares its id: the replacements of the id (``_m``) go into every text of it."""
    # the one-element array names the tokens, which are then made once
    tokens = F.array(F.regexp_extract_all(F.col(code), F.lit(TOKEN_RX), 0))

    def stretch(t, after, upto):
        return F.array_join(F.slice(t, after + 2, upto - after - 1), "")

    def glue(t):
        last = F.element_at("_m", -1)["pos"]
        parts = F.transform("_m", lambda r, i: F.concat(
            stretch(t, F.coalesce(F.get("_m", i - 1)["pos"], F.lit(-1)), r["pos"]), r["new_name"]))
        return F.concat(F.array_join(parts, ""), stretch(t, last, F.size(t)))

    return F.transform(tokens, glue)[0]
