"""Repair of conversation structure by layers of cost, and the damage that the query repairs.

A conversation is a sequence of rows of which each may have a fault: blank (nothing but ASCII white space), duplicate
(its role and text came before) or truncated (it doesn't end in `.`, `!` or `?`); the first that applies counts. Roles
must follow `(s?(ua)+)?` by their initials. Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for
blank and duplicate rows), Insert an empty user or assistant turn 5; a truncated row that isn't deleted adds 5.

Method: the grammar is an automaton of four states. Layer k of a place between two rows is the set of the states from
which the rest can be made right at a cost of at most k. All layers of a place are bits of one word, four bits a layer:
an edit is a shift by its cost after the set's step through the automaton. Words are made from the last row to the first.
The first layer of the first place that holds the start gives the cost; following from there, row by row, the first edit
in the order of ASCII whose state stands in the layer of what is left gives the least audit. A place's states never differ
by more than 12 in cost (any state is left by two insertions and a deletion), so 16 layers above the cheapest are kept.

At scale: what decides is narrow (a row's place, role initial and fault bits), is dealt by conversation and needs two
bytes a row while a conversation passes; the audit it gives is one cell in any case. Texts are dealt once, as a stream
behind their conversation's audit: no more than a batch of them is held, and a conversation's digest is computed as they
pass. So a conversation of any length runs in bounded memory, but in one task, as a digest is a chain.

Defined cases: a null conv_id, turn, role or text reads as one space wherever it is text; rows of a null conv_id are one
conversation; rows go by turn (null first), rows of one turn by role, by the first 64 characters of the text, then by the
text's hash; texts are told apart by two 64-bit hashes; a role that starts with none of s, u, a can't be kept; a
conversation without rows has an empty audit; texts of any length count whole; further columns don't pass and may have
any name; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.llm.common import stash

#: Costs of edits, of a truncated row that stays, and the layers that are kept.
REROLE, DELETE, INSERT, TRUNCATED, LAYERS = 1, 2, 5, 5, 16
#: States: the start, after s, after u, after a. Start and after a accept.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: What an inserted or reroled turn becomes.
ROLES = {START: ("u", "user"), SYSTEM: ("u", "user"), ASSISTANT: ("u", "user"), USER: ("a", "assistant")}
FULL = (1 << 4 * LAYERS) - 1
LANES = FULL // 15
#: Bits of a row's code: its initial in the lowest two (3: none of s, u, a), then the fault.
INITIALS = "sua"
BLANK, DUPLICATE, CUT = 4, 8, 16


def before(word: int, symbol: str) -> int:
    """The states from which a turn of that initial leads into the word's states, layer by layer."""
    out = 0
    for (state, x), to in NEXT.items():
        if x == symbol:
            out |= ((word >> to) & LANES) << state
    return out


def with_inserts(word: int) -> int:
    for _ in range(3):
        word |= (before(word, "u") | before(word, "a")) << 4 * INSERT & FULL
    return word


@lru_cache(maxsize=1 << 16)
def layers_before(word: int, code: int) -> tuple[int, int]:
    """The word of the place before a row of that code, given the one after it, and how much dearer its layer 0 is."""
    out = word << 4 * DELETE
    if not code & (BLANK | DUPLICATE):
        dearer = TRUNCATED if code & CUT else 0
        out |= (before(word, "u") | before(word, "a")) << 4 * (REROLE + dearer)
        if code & 3 < 3:
            out |= before(word, INITIALS[code & 3]) << 4 * dearer
    raised = 0
    while not out & 15:
        out >>= 4
        raised += 1
    return with_inserts(out & FULL), raised


LAST = with_inserts((LANES << START) | (LANES << ASSISTANT))


def cost_of(word: int, state: int) -> int:
    """The first layer that holds the state; more than any, if none does."""
    lane = (word >> state) & LANES
    return (lane & -lane).bit_length() // 4 if lane else 1 << 30


def repair(codes: bytes | bytearray) -> tuple[int, str]:
    """Least cost and least audit of a conversation whose rows have these codes."""
    words, rises, known, ids = array("i"), bytearray(), [LAST], {LAST: 0}
    word = LAST
    for code in reversed(codes):
        words.append(ids[word])
        word, raised = layers_before(word, code)
        rises.append(raised)
        if word not in ids:
            ids[word] = len(known)
            known.append(word)
    state, audit, cost = START, bytearray(), cost_of(word, START)
    total = cost + sum(rises)
    for code in codes:
        after, raised = known[words.pop()], rises.pop()
        dearer = TRUNCATED if code & CUT else 0
        while True:  # cost: what is left above the cheapest state of this place
            if cost_of(after, state) + DELETE - raised == cost:
                edit, to, paid = b"D", state, DELETE
            else:
                to = NEXT[state, ROLES[state][0]]
                if cost_of(word, to) + INSERT == cost:
                    audit += b"I"
                    state, cost = to, cost - INSERT
                    continue
                kept = NEXT.get((state, INITIALS[code & 3])) if code & 3 < 3 else None
                if kept is not None and cost_of(after, kept) + dearer - raised == cost:
                    edit, to, paid = b"K", kept, dearer
                else:
                    edit, paid = b"R", REROLE + dearer
            audit += edit
            state, cost, word = to, cost - paid + raised, after
            break
    while cost:
        audit += b"I"
        state, cost = NEXT[state, ROLES[state][0]], cost - INSERT
    return total, audit.decode()


# --- rows and their faults ---

INK = r"[^\x20\x09-\x0D]"


def spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `there`: rows by what crc32 of `conv_id:turn` modulo 20 does to them. 0 drops a row
    (it stays as one that isn't there, so that its conversation does), 1 empties the text, 2 takes its ends of
    sentences, 3 repeats the row, 4 makes it the user's."""
    dice = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), dice.alias("_dice"))
    text = F.when(F.col("_dice") == 1, "").when(F.col("_dice") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_dice") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_dice") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_dice") != 0).alias("there"), F.explode(times).alias("_copy")).drop("_copy")


#: The order of a conversation's rows, the same for what decides and for the texts.
KEYS = ("conv_id", "turn", "role", "_head", "_h1", "_h2")


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_head": F.left("text", F.lit(64)), "_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(7), "text")})


def judged(rows: DataFrame) -> DataFrame:
    """The rows without their texts, with their codes."""
    seen = F.row_number().over(W.partitionBy("conv_id", "there", "role", "_h1", "_h2").orderBy(F.col("turn").asc_nulls_first())) > 1
    end = F.right(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), F.lit(1))
    narrow = keyed(rows).withColumn("_fault", F.when(~F.col("text").rlike(INK), BLANK).when(~end.isin(".", "!", "?"), CUT).otherwise(0))
    at = F.instr(F.lit(INITIALS), F.left("role", F.lit(1)))
    initial = F.when((F.col("role") == "") | (at == 0), 3).otherwise(at - 1)
    narrow = narrow.select(*KEYS, "there", "_fault", initial.alias("_initial"))
    fault = F.when(F.col("_fault") == BLANK, BLANK).when(seen, DUPLICATE).otherwise(F.col("_fault"))
    return narrow.select(*KEYS, "there", (F.col("_initial") + fault).cast("int").alias("code"))


FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class _Conversation:
    """What is known of a conversation while its rows pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes = conv_id, bytearray()
        self.least = self.most = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, code: int) -> None:
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += 1
        if self.codes:
            last, this = self.codes[-1] & 3, code & 3
            self.illegal += last == 3 or this == 3 or (INITIALS[last], INITIALS[this]) not in LEGAL
        self.codes.append(code)

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        faults = [sum(self.codes.count(i | bit) for i in range(4)) for bit in (BLANK, DUPLICATE, CUT)]
        return (self.conv_id, gaps, *faults, self.illegal, *repair(self.codes))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation, whose rows come one after another."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in FOUND.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    now, done = None, []
    for batch in batches:
        for conv_id, turn, there, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "there", "code")), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Conversation(conv_id)
            if there:
                now.add(turn, code)
        if sum(len(r[-1]) for r in done) + len(done) > 4096:
            yield table(done)
            done = []
    yield table([*done, now.row()] if now is not None else done)


class _Script:
    """An audit applied to a conversation's rows as they pass."""

    def __init__(self, conv_id: int | None, audit: str):
        self.conv_id, self.audit, self.at, self.state = conv_id, audit, 0, START

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            symbol, role = ROLES[self.state]
            self.at, self.state = self.at + 1, NEXT[self.state, symbol]
            yield "I", role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of the turns that come of a row and stand before it."""
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            symbol, role = (role[0], role) if edit == "K" else ROLES[self.state]
            self.state = NEXT[self.state, symbol]
            yield edit, role, text


TURNS = "conv_id long, place long, edit string, role string, text string"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Script | None, list[tuple[str, str, str]], bool]]:
    """(script, turns, whether a batch ends here): an audit comes first, then its conversation's rows."""
    now = None
    for batch in batches:
        for conv_id, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if audit is not None:
                if now is not None:
                    yield now, list(now.inserts()), False
                now = _Script(conv_id, audit)
            else:
                yield now, list(now.row(role, text)), False
        yield now, [], True
    if now is not None:
        yield now, list(now.inserts()), True


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in TURNS.split(", ")]
    rows, last, place = [], None, 0
    for script, turns, end in _applied(batches):
        place = place if script is last else 0
        last = script
        for turn in turns:
            rows.append((script.conv_id, place, *turn))
            place += 1
        if end:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.string()) for k in range(5)], names=names)
            rows = []


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, digests, last, digest = [], [], None, None

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([d.hexdigest() for d in digests], pa.string())], names=["conv_id", "repaired_sha256"])

    for script, turns, end in _applied(batches):
        if script is not last:
            if last is not None:
                ids.append(last.conv_id)
                digests.append(digest)
            last, digest, first = script, hashlib.sha256(), True
        for _, role, text in turns:
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        if end:
            yield table()
            ids, digests = [], []
    if last is not None:
        ids.append(last.conv_id)
        digests.append(digest)
    yield table()


def decisions(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text, there) -> a stashed row per conversation: the columns of FOUND."""
    order = [F.col(c).asc_nulls_first() for c in KEYS]
    # Of equal rows of one turn, the one that isn't the duplicate comes first.
    dealt = judged(rows).repartition("conv_id").sortWithinPartitions(*order, "code").select("conv_id", "turn", "there", "code")
    return stash(dealt.mapInArrow(_decide, FOUND), "repairs")


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's audit and, behind it, its rows in order."""
    none, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    audits = found.where("audit <> ''").select("conv_id", "audit", none.alias("role"), none.alias("text"), number.alias("turn"), none.alias("_head"), number.alias("_h1"), number.alias("_h2"))
    texts = keyed(rows.where("there")).select("conv_id", none.alias("audit"), "role", "text", "turn", "_head", "_h1", "_h2")
    order = [F.col("conv_id").asc_nulls_first(), F.col("audit").asc_nulls_last(), *[F.col(c).asc_nulls_first() for c in KEYS[1:]]]
    return audits.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations, a row per turn: conv_id, place (from 0), edit (K, R or I), role and text."""
    return _stream(rows, decisions(rows)).mapInArrow(_turns, TURNS)


def repairs(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text, there) -> a row per conversation: the columns of FOUND and repaired_sha256, the
    digest of its repaired `role:text`, joined by \\n."""
    found = decisions(rows)
    digests = _stream(rows, found).mapInArrow(_digests, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "_conv")
    out = found.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
