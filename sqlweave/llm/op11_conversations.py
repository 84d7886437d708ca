"""Operator 11, conversation structure repair by a grammar-compressed dynamic programme.

A row's symbol is its role's initial (s, u, a, other) with or without truncation, or "must
go" for a blank or duplicate row. Edits lead through four states: nothing kept, after
system, after user, after assistant. Every symbol is a 4 x 4 min-plus matrix of cheapest costs
(insertions before the row included), and sequences are matrix products.

Rows are range-sorted by conversation and turn, so that one conversation may lie in many
tasks, and cut into blocks of at most BLOCK_ROWS rows. Re-Pair runs over the distinct
blocks: every round counts adjacent symbol pairs on the cluster and replaces frequent ones that
can't overlap by new symbols, until the best saves less than one symbol in SHARE. The rules
(at most MAX_RULES) are evaluated bottom-up, each once for all conversations: a matrix
and, for each pair of states, the state between its halves. These midpoints are the audit
rope: an edit string is read off by descending into both halves. Ties go to the
ASCII-least string; as each of the strings of one matrix row covers the same rows and ends in a row's edit,
none is a prefix of another, so their order within each row, four small ranks, is all that products need.

Blocks become matrices in parallel, a conversation's blocks are folded in order
(one small row per block), edit strings are read off per block in parallel, and texts are
streamed once, sorted, through the hash of the repaired conversation, in bounded memory.

Nulls: a null role or text is one blank, hence another role or a blank row; null turns come
first and count for no gap; rows with a null conv_id are one conversation. Empty texts are blank
rows. Rows that tie in their turn are ordered by role, the text's first 64 characters, then its digest. Repeated rows are
duplicates after the first. Very long texts pass through whole. Extra columns are
ignored; tables without rows give no rows.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sqlweave.llm.common import load
from sqlweave.session import drop_table, ship_package, write_table

BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 20
SHARE, MAX_RULES, PAIRS_A_ROUND = 128, 4096, 256
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5  # what edits cost
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
BASE = 9  # symbols: 0 must go, 1 + 2 * role + truncated
AFTER = {"user": (START, SYSTEM, ASSISTANT), "assistant": (USER,)}  # states that a role may follow
INSERTS = {(s, s): 0 for s in STATES} | {(START, USER): 1, (START, ASSISTANT): 2, (SYSTEM, USER): 1,
                                         (SYSTEM, ASSISTANT): 2, (USER, ASSISTANT): 1, (ASSISTANT, USER): 1}
TO_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # insertions that complete a conversation
SPACES = " \t\n\x0b\x0c\r"


class Matrix:
    """Cheapest ways between states: ``cost`` (None: no way), ``rank`` of its string in its row, ``mid``."""

    __slots__ = ("cost", "rank", "mid")

    def __init__(self, cost, rank, mid):
        self.cost, self.rank, self.mid = cost, rank, mid


def _ranks(keys: list) -> list[int]:
    order = sorted((k, j) for j, k in enumerate(keys) if k is not None)
    out = [0] * len(keys)
    for r, (_, j) in enumerate(order):
        out[j] = r
    return out


def symbol_matrix(symbol: int) -> Matrix:
    """The matrix of one row; ``mid`` holds the edit strings themselves."""
    moves = [(s, s, DELETE, "D") for s in STATES]
    if symbol:
        role, extra = (symbol - 1) // 2, TRUNCATED * ((symbol - 1) % 2)
        moves += [(s, USER, REROLE + extra, "R") for s in AFTER["user"]]
        moves += [(s, ASSISTANT, REROLE + extra, "R") for s in AFTER["assistant"]]
        keeps = {0: [(START, SYSTEM)], 1: [(s, USER) for s in AFTER["user"]], 2: [(USER, ASSISTANT)], 3: []}[role]
        moves += [(s, t, extra, "K") for s, t in keeps]
    ways: dict = {}
    for (i, k), n in INSERTS.items():
        for a, j, cost, edit in moves:
            if a == k:
                way = (cost + INSERT * n, "I" * n + edit)
                ways[i, j] = min(way, ways.get((i, j), way))
    got = [[ways.get((i, j), (None, None)) for j in STATES] for i in STATES]
    return Matrix([[c for c, _ in row] for row in got], [_ranks([x for _, x in row]) for row in got],
                  [[x for _, x in row] for row in got])


def step(cost, rank, y: Matrix):
    """One row (costs and ranks from a fixed state) times a matrix: (cost, rank, mid)."""
    out, mid, keys = [None] * 4, [None] * 4, [None] * 4
    for j in STATES:
        best = None
        for k in STATES:
            if cost[k] is not None and y.cost[k][j] is not None:
                way = (cost[k] + y.cost[k][j], rank[k], k)
                if best is None or way < best:
                    best = way
        if best is not None:
            out[j], mid[j] = best[0], best[2]
            keys[j] = (best[1], y.rank[best[2]][j])
    return out, _ranks(keys), mid


def product(x: Matrix, y: Matrix) -> Matrix:
    return Matrix(*map(list, zip(*(step(x.cost[i], x.rank[i], y) for i in STATES))))


class Grammar:
    """The matrices of all symbols: nine of rows, then one of each rule, evaluated bottom-up."""

    def __init__(self, rules: list[tuple[int, int]]):
        self.rules = rules
        self.matrices = [symbol_matrix(s) for s in range(BASE)]
        for a, b in rules:
            self.matrices.append(product(self.matrices[a], self.matrices[b]))

    def compose(self, symbols: list[int]) -> tuple[list, list]:
        """(cost, rank) of a sequence, as lists of four rows."""
        rows = []
        for i in STATES:
            first = self.matrices[symbols[0]]
            cost, rank = first.cost[i], first.rank[i]
            for s in symbols[1:]:
                cost, rank, _ = step(cost, rank, self.matrices[s])
            rows.append((cost, rank))
        return [c for c, _ in rows], [r for _, r in rows]

    def audit(self, symbols: list[int], begin: int, end: int) -> str:
        """Edit string of the cheapest way of a sequence between two states."""
        first = self.matrices[symbols[0]]
        cost, rank, mids = first.cost[begin], first.rank[begin], []
        for s in symbols[1:]:
            cost, rank, mid = step(cost, rank, self.matrices[s])
            mids.append(mid)
        todo, at = [], end  # (symbol, from, to), last symbol first
        for s, mid in zip(reversed(symbols[1:]), reversed(mids)):
            todo.append((s, mid[at], at))
            at = mid[at]
        todo.append((symbols[0], begin, at))
        out = []
        while todo:
            s, i, j = todo.pop()
            mid = self.matrices[s].mid[i][j]
            if s < BASE:
                out.append(mid)
            else:
                a, b = self.rules[s - BASE]
                todo += [(b, mid, j), (a, i, mid)]
        return "".join(out)


def replace_pairs(seq: np.ndarray, rules: dict[tuple[int, int], int]) -> np.ndarray:
    """Every pair of a round's rules replaced from left to right; rules of one round can't overlap."""
    for (a, b), new in rules.items():
        hit = np.flatnonzero((seq[:-1] == a) & (seq[1:] == b))
        if len(hit):
            if a == b:  # every second one of a stretch
                first = np.concatenate(([True], np.diff(hit) != 1))
                begin = hit[first][np.cumsum(first) - 1]
                hit = hit[(hit - begin) % 2 == 0]
            seq = seq.copy()
            seq[hit] = new
            seq = np.delete(seq, hit + 1)
    return seq


def parse(syms: bytes, rounds: list[dict]) -> list[int]:
    seq = np.frombuffer(syms, np.uint8).astype(np.uint16)
    for rules in rounds:
        seq = replace_pairs(seq, rules)
    return seq.tolist()


def pick_rules(counts: list[tuple[int, int, int]], total: int, first: int) -> dict[tuple[int, int], int]:
    """The round's rules from the most frequent pairs (a, b, n): no right part is another's left part."""
    out: dict = {}
    lefts, rights = set(), set()
    for a, b, n in counts:
        if n < 2 or n * SHARE < total or first + len(out) >= BASE + MAX_RULES:
            break
        if a == b and not out:
            return {(a, b): first}
        if a == b or a in rights or b in lefts:
            continue
        out[a, b] = first + len(out)
        lefts.add(a)
        rights.add(b)
    return out


def repair_grammar(blocks: DataFrame, syms: str = "syms") -> list[dict[tuple[int, int], int]]:
    """Rules by round, from pair counts over all distinct sequences, weighted by how often each is found."""
    seqs = write_table(blocks.groupBy(syms).agg(F.count(F.lit(1)).alias("n")), "sequences")
    rounds: list[dict] = []
    while True:
        last = rounds[-1] if rounds else {}

        def rewrite(batches):
            for b in batches:
                kind = np.uint16 if rounds else np.uint8
                out = [replace_pairs(np.frombuffer(x, kind).astype(np.uint16), last) for x in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes() for x in out], pa.binary()), b.column(1)], ["seq", "n"])

        def pairs(batches):
            count: dict = {}
            for b in batches:
                for x, n in zip(*(c.to_pylist() for c in b.columns)):
                    seq = np.frombuffer(x, np.uint16).astype(np.uint32)
                    found, times = np.unique(seq[:-1] << 16 | seq[1:], return_counts=True)
                    for p, t in zip(found.tolist(), times.tolist()):
                        count[p] = count.get(p, 0) + t * n
                    count[-1] = count.get(-1, 0) + len(seq) * n  # symbols in all
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()),
                                              pa.array(list(count.values()), pa.int64())], ["pair", "n"])
        old, seqs = seqs, write_table(seqs.mapInArrow(rewrite, "seq binary, n long"), "sequences")
        drop_table(old)
        top = (seqs.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
               .orderBy(F.col("pair") >= 0, F.desc("n"), "pair").limit(PAIRS_A_ROUND).collect())
        total = next((r["n"] for r in top if r["pair"] < 0), 0)
        rules = pick_rules([(r["pair"] >> 16, r["pair"] & 0xFFFF, r["n"]) for r in top if r["pair"] >= 0],
                           total, BASE + sum(map(len, rounds)))
        if not rules:
            drop_table(seqs)
            return rounds
        rounds.append(rules)


def marked(rows: DataFrame) -> DataFrame:
    """Rows with ``fault`` (blank, duplicate, truncated or null), ``sym`` and the order of ties."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    rows = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text")).withColumn("digest", F.sha2("text", 256))
    rows = write_table(rows.withColumn("_row", F.monotonically_increasing_id()), "turns")
    first = (rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
             .agg(F.min(F.struct("turn", "_row")).alias("x"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select("c", "r", "d", F.col("x._row").alias("first")))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                     & (F.col("digest") == F.col("d")), "left")
    rows = rows.withColumn("fault", F.when(blank, "blank").when(F.col("first") != F.col("_row"), "duplicate")
                           .when(~end.isin(".", "!", "?"), "truncated"))
    role = F.greatest(F.instr(F.lit("sua"), F.left("role", F.lit(1))), F.lit(0))  # 0: another one
    role = F.when((F.col("role") == "") | (role == 0), 3).otherwise(role - 1)
    sym = F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(
        1 + 2 * role + (F.coalesce("fault", F.lit("")) == "truncated").cast("int"))
    return rows.withColumn("sym", sym.cast("int")).drop("c", "r", "d", "first")


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks of consecutive rows of a conversation, in order of (part, seq), from one range sort."""
    spark = rows.sparkSession
    order = ["conv_id", "turn", "role", "head", "digest", "_row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (rows.withColumn("head", F.substring("text", 1, 64))
            .repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .select("conv_id", "turn", "role", "text", "fault", "sym"))
    names = ["conv_id", "part", "seq", "syms", "roles", "texts", "first_turn", "last_turn", "turns", "first_role",
             "last_role", "blank", "duplicate", "truncated", "illegal"]
    ctype = rows.schema["conv_id"].dataType.simpleString()
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64(),
             pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        conv, rows, chars, kind = None, [], 0, None

        def block():
            turns = [r[0] for r in rows if r[0] is not None]
            initials = [r[1][:1] for r in rows]
            faults = [r[3] for r in rows]
            values = [conv, part, seq, bytes(r[4] for r in rows), [r[1] for r in rows], [r[2] for r in rows],
                      turns[0] if turns else None, turns[-1] if turns else None,
                      sum(1 for _ in groupby(turns)), initials[0], initials[-1],
                      *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
                      sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, [kind, *kinds])], names)

        for b in batches:
            kind, out = b.column(0).type, []
            for c, *rest in zip(*(x.to_pylist() for x in b.columns)):
                if rows and (c != conv or len(rows) >= BLOCK_ROWS or chars >= BLOCK_CHARS):
                    out.append(block())
                    rows, chars, seq = [], 0, seq + 1
                conv, chars = c, chars + len(rest[2])
                rows.append(rest)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if rows:
            yield block()
    return rows.mapInArrow(run, f"conv_id {ctype}, part long, seq long, syms binary, roles array<string>, "
                                "texts array<string>, first_turn long, last_turn long, turns long, first_role string, "
                                "last_role string, blank long, duplicate long, truncated long, illegal long")


def _stream(batches, columns: list[str]):
    """Rows as tuples, by conversation: (conv_id, iterator of rows)."""
    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ["conv_id", *columns]))
    for conv, group in groupby(rows(), key=lambda r: (r[0],)):
        yield conv[0], (r[1:] for r in group)


FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def paths_of(blocks: DataFrame, rounds: list[dict]) -> DataFrame:
    """(conv_id, part, seq, syms, begin, end, tail, facts): each block's states on the cheapest way.

    ``tail`` (insertions at the end) and the facts stand on a conversation's last block.
    """
    rules = [pair for r in rounds for pair in r]
    slim = ["part", "seq", "syms", "first_turn", "last_turn", "turns", "first_role", "last_role", "blank",
            "duplicate", "truncated", "illegal"]

    def matrices(batches):
        grammar, memo = Grammar(rules), {}
        for b in batches:
            costs, ranks = [], []
            for syms in b.column("syms").to_pylist():
                if syms not in memo:
                    if len(memo) >= 100_000:
                        memo.clear()
                    cost, rank = grammar.compose(parse(syms, rounds))
                    memo[syms] = ([c for row in cost for c in row], [r for row in rank for r in row])
                cost, rank = memo[syms]
                costs.append(cost)
                ranks.append(rank)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(costs, pa.list_(pa.int64())),
                                              pa.array(ranks, pa.list_(pa.int32()))], [*b.schema.names, "costs", "ranks"])

    def fold(batches):
        for conv, rows in _stream(batches, [*slim, "costs", "ranks"]):
            cost, rank, mids, kept = None, None, [], []
            low = high = last_role = None
            turns = blank = duplicate = truncated = illegal = 0
            for part, seq, syms, a, z, n, r1, r2, nb, nd, nt, ni, costs, ranks in rows:
                m = Matrix([costs[i:i + 4] for i in range(0, 16, 4)], [ranks[i:i + 4] for i in range(0, 16, 4)], None)
                if cost is None:
                    cost, rank, mid = m.cost[START], m.rank[START], [START] * 4
                else:
                    cost, rank, mid = step(cost, rank, m)
                    illegal += last_role + r1 not in ("su", "ua", "au")
                mids.append(mid)
                kept.append((part, seq, syms))
                turns += n - (n > 0 and a == high)
                low, high = a if low is None else low, high if z is None else z
                last_role = r2
                blank, duplicate, truncated, illegal = blank + nb, duplicate + nd, truncated + nt, illegal + ni
            total, _, end = min((cost[s] + INSERT * TO_END[s], rank[s], s) for s in STATES if cost[s] is not None)
            facts = [0 if low is None else high - low + 1 - turns, blank, duplicate, truncated, illegal, total]
            at, ways = end, []
            for mid in reversed(mids):
                ways.append((mid[at], at))
                at = mid[at]
            ways.reverse()
            for i in range(0, len(kept), 1000):
                some, way = kept[i:i + 1000], ways[i:i + 1000]
                last = [i + j == len(kept) - 1 for j in range(len(some))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv] * len(some), kind), *(pa.array(x, t) for x, t in zip(
                        zip(*some), (pa.int64(), pa.int64(), pa.binary()))),
                     *(pa.array(x, pa.int32()) for x in zip(*way)),
                     pa.array(["I" * TO_END[end] if x else None for x in last], pa.string()),
                     *(pa.array([f if x else None for x in last], pa.int64()) for f in facts)],
                    ["conv_id", "part", "seq", "syms", "begin", "end", "tail", *FACTS])

    field = blocks.schema["conv_id"].dataType
    kind = to_arrow_type(field)
    schema = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in ["conv_id", *slim])
    folded = (blocks.select("conv_id", *slim).mapInArrow(matrices, schema + ", costs array<long>, ranks array<int>")
              .repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id")
              .sortWithinPartitions("conv_id", "part", "seq"))
    return folded.mapInArrow(fold, f"conv_id {field.simpleString()}, part long, seq long, syms binary, begin int, "
                                   f"end int, tail string, {', '.join(f'{c} long' for c in FACTS)}")


def audits_of(paths: DataFrame, rounds: list[dict]) -> DataFrame:
    """``paths`` with each block's edit string."""
    rules = [pair for r in rounds for pair in r]

    def run(batches):
        grammar, memo = Grammar(rules), {}
        for b in batches:
            out = []
            for key in zip(*(b.column(c).to_pylist() for c in ("syms", "begin", "end"))):
                if key not in memo:
                    if len(memo) >= 100_000:
                        memo.clear()
                    memo[key] = grammar.audit(parse(key[0], rounds), key[1], key[2])
                out.append(memo[key])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "audit"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paths.schema.fields)
    return paths.repartition("conv_id", "part", "seq").mapInArrow(run, schema + ", audit string")


def edited(audit: str, roles: list[str], texts: list[str], state: int):
    """(repaired lines, state after them)."""
    lines, at = [], 0
    for e in audit:
        role, text = ("assistant" if state == USER else "user"), ""
        if e != "I":
            text = texts[at]
            if e == "K":
                role = roles[at]
            at += 1
        if e != "D":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            lines.append(f"{role}:{text}")
    return lines, state


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text): facts, cost, audit, digest of the repaired rows."""
    spark = rows.sparkSession
    ship_package(spark)
    turns = marked(rows)
    blocks = write_table(blocks_of(turns), "blocks")
    rounds = repair_grammar(blocks)
    paths = write_table(paths_of(blocks, rounds), "paths")
    audits = audits_of(paths, rounds).withColumn("kind", F.lit(0)).drop("syms", "end")
    lines = blocks.select("conv_id", "part", "seq", "roles", "texts").withColumn("kind", F.lit(1))
    both = (audits.unionByName(lines, allowMissingColumns=True)
            .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
            .sortWithinPartitions("conv_id", "part", "seq", "kind"))
    field = blocks.schema["conv_id"].dataType
    ctype = to_arrow_type(field)

    def finish(batches):
        out = []
        for conv, group in _stream(batches, ["kind", "begin", "audit", "roles", "texts", "tail", *FACTS]):
            digest, audit, any_line, state, facts, tail, piece = hashlib.sha256(), [], False, START, None, "", ""
            for kind, begin, edits, roles, texts, end, *values in group:
                if kind == 0:
                    piece = edits
                    audit.append(edits)
                    if end is not None:
                        tail, facts = end, values
                    continue
                done, state = edited(piece, roles, texts, state)
                if done:
                    digest.update((("\n" if any_line else "") + "\n".join(done)).encode("utf-8", "surrogatepass"))
                    any_line = True
            done, _ = edited(tail, [], [], state)
            if done:
                digest.update((("\n" if any_line else "") + "\n".join(done)).encode())
            out.append((conv, *facts, "".join(audit) + tail, digest.hexdigest()))
            if len(out) >= 1000 or len(out[-1][-2]) > 1 << 20:
                yield _batch(out, ctype)
                out = []
        if out:
            yield _batch(out, ctype)
    return both.mapInArrow(finish, f"conv_id {field.simpleString()}, {', '.join(f'{c} long' for c in FACTS)}, "
                                   "audit string, repaired_sha256 string")


def _batch(rows: list[tuple], ctype) -> pa.RecordBatch:
    kinds = [ctype, *[pa.int64()] * len(FACTS), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                      ["conv_id", *FACTS, "audit", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user, by a checksum of conv_id and turn."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))
    d = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"),
                             F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_case"))
    text = (F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    copies = F.explode(F.when(F.col("_case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return (d.filter("_case != 0")
            .select("conv_id", "turn", F.when(F.col("_case") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), copies.alias("_copy")).drop("_copy"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after the damage."""
    conversations = load(spark, sf_dir, "conversations")
    fixed = repair(damaged(conversations))
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in FACTS]
    return ids.join(fixed, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {"op11_conversations": op11_conversations}
SQL: dict[str, str] = {}
