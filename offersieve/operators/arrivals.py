"""Figures as of each arrival: counts, sums and BM25 scores over the last `limit` documents up to and with each one.

Running sums go by blocks of arrivals: a row also goes to the next block if it still counts there, so each block is summed alone,
once up to each row and once up to the row that is `limit` back. So a window holds the arrivals of one block and the
`limit` before it, however common a term is.

Defined results: `seq` is dense from 0 and unique; null and empty token lists are documents of length 0 that count in n; a
score is 0 where no term of the user stands; equal rows of the terms table count once, of several weights the largest; an empty
term stands nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offersieve.operators.lineage import written

BLOCK = 4096


def _ahead(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part, ahead: the sum of s over the key's earlier parts, by groups of BLOCK parts."""
    at = sums.withColumn("up", F.floor(F.col("part") / BLOCK))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = at.groupBy(*keys, "up").agg(F.sum("s").alias("t"))
    base = groups.select(*keys, "up", F.coalesce(F.sum("t").over(earlier(Window.partitionBy(*keys).orderBy("up"))), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("s").over(earlier(Window.partitionBy(*keys, "up").orderBy("part"))), F.lit(0))
    return at.join(base, [*keys, "up"]).select(*keys, "part", (F.col("base") + within).alias("ahead"))


def dense(rows: DataFrame, by: str) -> DataFrame:
    """rows with seq, the rank from 0 by the whole number `by`, which is unique and not much sparser than the rows."""
    at = rows.withColumn("part", F.floor(F.col(by) / BLOCK))
    first = _ahead(at.groupBy("part").agg(F.count("*").alias("s")), [])
    rank = F.row_number().over(Window.partitionBy("part").orderBy(by))
    return at.join(first, "part").withColumn("seq", F.col("ahead") + rank - 1).drop("part", "ahead")


def _blocks(limit: int, block: int = BLOCK) -> tuple[Column, Column]:
    """A row's own block of arrivals, and all in which it counts: its own and, near its end, the next."""
    own = lambda seq: F.floor(seq / max(block, limit))
    return own(F.col("seq")), F.sequence(own(F.col("seq")), own(F.col("seq") + max(limit, 1) - 1))


def last_sums(rows: DataFrame, keys: list[str], value: Column, limit: int, carried: list[str] = []) -> DataFrame:  # noqa: B006
    """keys, seq, the carried columns and total: for each row, the sum of `value` over its key's rows among the last
    `limit` arrivals."""
    own, every = _blocks(limit)
    at = rows.select(*keys, "seq", value.alias("v"), *carried, F.explode(every).alias("part"))
    upto = lambda n: F.sum("v").over(Window.partitionBy(*keys, "part").orderBy("seq").rangeBetween(Window.unboundedPreceding, n))
    total = upto(0) - F.coalesce(upto(-limit), F.lit(0))
    return at.withColumn("total", total).filter(F.col("part") == own).select(*keys, "seq", *carried, "total")


def rolling_stats(docs: DataFrame, limit: int, length: str = "len") -> DataFrame:
    """seq, len, n, avgdl of the last `limit` documents up to and with each one."""
    n = F.least(F.col("seq") + 1, F.lit(limit))
    sums = last_sums(docs.select("seq", F.col(length).alias("len")), [], F.col("len").cast("long"), limit, ["len"])
    return sums.select("seq", "len", n.alias("n"), (F.col("total") / n).alias("avgdl"))


def rolling_df(postings: DataFrame, limit: int, carried: list[str] = []) -> DataFrame:  # noqa: B006
    """seq, term, df (documents with the term among the last `limit`) and the carried columns of distinct postings."""
    return last_sums(postings, ["term"], F.lit(1).cast("long"), limit, carried).withColumnRenamed("total", "df")


def postings(docs: DataFrame, by: str, tokens: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two small tables from one pass over the texts: seq, `by` and len of every document, and seq, term, tf of the terms
    asked for. The pass keeps those terms and, under the empty term, the length; token lists are neither shuffled
    nor written unless the terms are too many to broadcast by the session's own threshold."""
    asked = terms.select("term").filter("term <> ''").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    size = F.greatest(F.coalesce(F.size(tokens), F.lit(0)), F.lit(0))
    each = F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), F.lit(1).alias("n")))
    rows = docs.select(by, F.inline(F.concat(each, F.array(F.struct(F.lit("").alias("term"), size.alias("n"))))))
    met = written(rows.join(asked, "term", "left_semi").groupBy(by, "term").agg(F.sum("n").alias("n")))
    lengths = written(dense(met.filter("term = ''").select(by, F.col("n").alias("len")), by))
    return lengths, written(met.filter("term <> ''").join(lengths, by).select("seq", "term", F.col("n").alias("tf")))


def scores(lengths: DataFrame, posted: DataFrame, terms: DataFrame, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """user_id, seq, score of every pair in which a term of the user stands; each document is scored against the last
    `limit` arrivals, itself included, as it was inserted before it is judged.

    lengths and posted: of `postings`. terms: user_id, term, weight, of any size; only the terms that some user asks for
    have postings, and counts of a term serve all its users."""
    terms = terms.groupBy("user_id", "term").agg(F.max("weight").alias("weight"))
    at = rolling_df(posted, limit, ["tf"]).join(rolling_stats(lengths, limit), "seq")
    tf, n, df = F.col("tf").cast("double"), F.col("n"), F.col("df")
    part = F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.greatest("avgdl", F.lit(1.0))))
    return at.select("seq", "term", part.alias("part")).join(terms, "term").groupBy("user_id", "seq").agg(F.sum(F.col("weight") * F.col("part")).alias("score"))


#: Arrivals and users that one task of `best_users` holds; where users have many terms, up to four times the arrivals, and
#: users up to four terms each on the average.
AT_ONCE, USERS = 8192, 1 << 20
#: Users' terms for each arrival of a block from which on blocks are made larger, so that users' terms stay few beside texts.
PER_ARRIVAL = 32


def _concerned(term: np.ndarray, at: np.ndarray, docs: int, term_of: np.ndarray, first_of: np.ndarray, many_of: np.ndarray) -> np.ndarray:
    """For each of the documents 0 to docs - 1 the number of users with a term in it. term, at: distinct, in order.
    A user's terms stand in term_of from first_of on.

    A term is a row of bits, one a document, a user the union of rows; users' rows are added up bit by bit, three rows
    of one weight to a row of it and a row of the double."""
    import numpy as np

    out, wide, at_once = np.zeros(docs, "int64"), 64, 2048
    order = np.argsort(-many_of, kind="stable")
    first_of, many_of = first_of[order], many_of[order]
    for low in range(0, docs, 64 * wide):
        inside = (at >= low) & (at < low + 64 * wide)
        if not inside.any():
            continue
        here, bit = term[inside] * wide + (at[inside] - low) // 64, np.uint64(1) << ((at[inside] - low) % 64).astype("uint64")
        starts = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
        said = np.zeros((term_of.max() + 1, wide), "uint64")
        said.reshape(-1)[here[starts]] = np.bitwise_or.reduceat(bit, starts)
        sums = np.zeros(64 * wide, "int64")
        for a in range(0, len(first_of), at_once):
            firsts, many = first_of[a : a + at_once], many_of[a : a + at_once]
            rows, weight = said.take(term_of[firsts], 0), 1
            for k in range(1, many[0]):
                more = int((-many).searchsorted(-k))
                rows[:more] |= said.take(term_of[firsts[:more] + k], 0)
            while len(rows):
                doubles = [rows[:0]]
                while len(rows) > 2:
                    n = len(rows) // 3
                    odd = rows[:n] ^ rows[n : 2 * n]
                    doubles.append((rows[:n] & rows[n : 2 * n]) | (odd & rows[2 * n : 3 * n]))
                    rows = np.concatenate([odd ^ rows[2 * n : 3 * n], rows[3 * n :]])
                sums += weight * np.unpackbits(rows.astype("<u8").view("uint8"), axis=1, bitorder="little").sum(0, dtype="int64")
                rows, weight = np.concatenate(doubles), 2 * weight
        out[low : low + 64 * wide] = sums[: docs - low]
    return out


def best_users(docs: DataFrame, by: str, tokens: str, terms: DataFrame, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Per document in which a term of any user stands: `by`, n_users, best_user, best_score, total of the users' `scores`, rounded
    to 6 and 4 digits; ties go to the smaller user.

    Pairs of documents and users grow with the product of both, so none is a row and few are scored: blocks of arrivals, with
    the `limit` before each, meet blocks of users. The total needs only each term's sum of weights. Users are scored by falling
    bounds of their terms, until no user with none of the terms gone through can reach the best; only to be counted,
    each user of each term is marked. Tokens hold no space."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    weighted = written(terms.filter("term <> ''").groupBy("user_id", "term").agg(F.max("weight").alias("weight")))
    n_users, n_rows = weighted.agg(F.count_distinct("user_id"), F.count("*")).first()
    shards = max(-(-n_users // USERS), -(-n_rows // (4 * USERS)), 1)
    at_once = min(max(AT_ONCE, n_rows // PER_ARRIVAL), 4 * AT_ONCE)
    block = max(at_once, limit)
    seqs = dense(docs.select(by), by)
    # a block's arrivals lie between two ids, so texts meet small ranges and are shuffled once
    part = F.floor(F.col(by) / BLOCK)
    ranges = written(seqs.select(by, "seq", F.explode(_blocks(limit, at_once)[1]).alias("block")).groupBy(part.alias("part"), "block").agg(F.min(by).alias("low"), F.max(by).alias("high"), F.min("seq").alias("first"), F.max("seq").alias("last")))
    blocks = (ranges.agg(F.max("last")).first()[0] or 0) // block + 1
    size = F.greatest(F.coalesce(F.size(tokens), F.lit(0)), F.lit(0))
    texts = docs.select(by, size.cast("long").alias("len"), F.array_join(F.coalesce(tokens, F.array().cast("array<string>")), " ").alias("words"), part.alias("part"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = texts.join(ranges, "part").filter(F.col(by).between(F.col("low"), F.col("high"))).select(by, "len", "words", "first", "block", each(shards).alias("shard"))
    shard = F.pmod(F.xxhash64("user_id"), F.lit(shards).cast("long")).alias("shard")
    listed = written(weighted.groupBy(shard, "term").agg(F.collect_list(F.struct("user_id", "weight")).alias("of")).select("shard", "term", F.col("of.user_id").alias("users"), F.col("of.weight").alias("weights")))
    right = listed.withColumn("block", each(blocks))
    schema = pa.schema([(by, pa.int64()), ("user_id", pa.int64()), ("score", pa.float64()), ("n", pa.int64()), ("s", pa.float64())])

    def run(key: tuple, d: pa.Table, u: pa.Table) -> pa.Table:
        if not d.num_rows or not u.num_rows:
            return schema.empty_table()
        ids = d[by].to_numpy().astype("int64")
        order = np.argsort(ids)
        place = np.empty(len(ids), "int64")
        place[order] = np.arange(len(ids))
        ids, length, seq = ids[order], d["len"].to_numpy()[order], d["first"].to_numpy().min() + np.arange(len(ids))
        # users by term, and terms by user
        names = u["term"].combine_chunks()
        many = pc.list_value_length(u["users"]).to_numpy()
        first = np.concatenate([[0], np.cumsum(many)])
        users, user = np.unique(pc.list_flatten(u["users"]).to_numpy(), return_inverse=True)
        weight = pc.list_flatten(u["weights"]).to_numpy()
        most, whole = np.maximum(np.maximum.reduceat(weight, first[:-1]), 0.0), np.add.reduceat(weight, first[:-1])
        order = np.argsort(user, kind="stable")
        term_of, weight_of = np.repeat(np.arange(len(names)), many)[order], weight[order]
        many_of = np.bincount(user)
        first_of, widest = np.cumsum(many_of) - many_of, int(many_of.max())
        # entries: a document's place, a term and how often it stands there
        found, i = [], 0
        for chunk in d["words"].chunks:
            for k in range(0, len(chunk), 2048):
                split = pc.split_pattern(chunk.slice(k, 2048), " ")
                at = np.repeat(place[i : i + len(split)], pc.list_value_length(split).to_numpy())
                t = pc.fill_null(pc.index_in(pc.list_flatten(split), value_set=names), -1).to_numpy().astype("int64")
                found.append(np.unique(t[t >= 0] * len(ids) + at[t >= 0], return_counts=True))
                i += len(split)
        keys, tf = np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])
        order = np.argsort(keys)
        keys, tf = keys[order], tf[order]
        t, at = np.divmod(keys, len(ids))
        # documents with the term among the last `limit`; places are dense, as arrivals are
        df = np.arange(len(keys)) - np.searchsorted(keys, t * len(ids) + np.maximum(at - limit + 1, 0)) + 1
        upto = np.concatenate([[0], np.cumsum(length)])
        n = np.minimum(seq + 1, limit)
        mean = np.maximum((upto[1:] - upto[np.maximum(np.arange(len(ids)) - limit + 1, 0)]) / n, 1.0)
        part = np.log(1 + (n[at] - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[at] / mean[at]))
        mine = np.flatnonzero(seq // block == key[0].as_py())
        low, high = (mine[0], mine[-1] + 1) if len(mine) else (0, 0)
        inside = (at >= low) & (at < high)
        concerned = _concerned(t[inside], at[inside] - low, high - low, term_of, first_of, many_of)
        # a document's terms by falling bound, and what a user with none of the terms before can reach at most
        bound = part * most[t]
        falling = at * (bound.max(initial=0.0) + 1.0) - bound
        order = np.argsort(falling)
        t, at, part, bound = t[order], at[order], part[order], bound[order]
        ends = np.searchsorted(at, np.arange(len(ids) + 1))
        upto, rows = np.concatenate([[0.0], np.cumsum(bound)]), np.cumsum(many[t])
        reach = upto[np.minimum(np.arange(len(t)) + widest, ends[at + 1])] - upto[:-1]
        # near the best: all that rounding may draw level, and what sums and order here may be off by
        slack = 4e-6 + 4 * widest * (np.spacing(np.abs(falling).max(initial=0.0)) + np.spacing(upto[-1]))
        total = np.bincount(at, part * whole[t], len(ids))
        parts = np.zeros(len(names) + 1)
        slices = list(zip(first[:-1].tolist(), first[1:].tolist()))
        of, terms_ = [user[a:z] for a, z in slices], t.tolist()
        if widest <= 4:
            # all terms of a term's users lie beside them
            cell = np.repeat(np.arange(len(users)) * widest - first_of, many_of) + np.arange(len(user))
            term_at, weight_at = np.full(len(users) * widest, len(names)), np.zeros(len(users) * widest)
            term_at[cell], weight_at[cell] = term_of, weight_of
            term_at, weight_at = term_at.reshape(-1, widest)[user], weight_at.reshape(-1, widest)[user]
            beside = [(term_at[a:z], weight_at[a:z]) for a, z in slices]

        def scored(among: list, who: np.ndarray) -> np.ndarray:
            if widest <= 4:
                said, weighed = zip(*[beside[k] for k in among])
                return np.einsum("ij,ij->i", np.concatenate(weighed), parts.take(np.concatenate(said)))
            starts = np.cumsum(many_of[who]) - many_of[who]
            at_rows = np.repeat(first_of[who] - starts, many_of[who]) + np.arange(many_of[who].sum())
            return np.add.reduceat(weight_of[at_rows] * parts[term_of[at_rows]], starts)

        places, best, scores, hits, sums = [], [], [], [], []
        for i in mine[np.diff(ends)[mine] > 0].tolist():
            done, end, top, step, near = int(ends[i]), int(ends[i + 1]), -np.inf, 1024, []
            before = rows[done] - many[t[done]]
            said = t[done:end]
            parts[said] = part[done:end]
            while done < end and reach[done] >= top - slack:
                more = max(done + int(rows[done:end].searchsorted(before + step, "right")), done + 1)
                if near:
                    more = min(more, done + max(int((-reach[done:end]).searchsorted(slack - top, "right")), 1))
                among = terms_[done:more]
                who = np.concatenate([of[k] for k in among])
                score = scored(among, who)
                top = max(top, score.max())
                close = score >= top - 2e-6
                near.append((who[close], score[close]))
                done, step = more, 4 * max(step, int(rows[more - 1] - before))
            parts[said] = 0.0
            # the best before rounding and all that rounding may draw level, of equal scores the smallest user
            level = {}
            for who, score in near:
                for w, x in zip(who.tolist(), score.tolist()):
                    if x >= top - 2e-6:
                        level[x] = min(level.get(x, w), w)
            more = [0] * (len(level) - 1)
            places += [i] * len(level)
            best += level.values()
            scores += level
            hits += [int(concerned[i - low]), *more]
            sums += [float(total[i]), *more]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((ids[places] if places else [], users[best] if best else [], scores, hits, sums), schema)], schema=schema)

    pairs = ["block", "shard"]
    found = left.groupBy(*pairs).cogroup(right.groupBy(*pairs)).applyInArrow(run, f"{by} long, user_id long, score double, n long, s double")
    best = F.max_by("user_id", F.struct(F.round("score", 6), -F.col("user_id")))
    return found.groupBy(by).agg(F.sum("n").alias("n_users"), best.alias("best_user"), F.round(F.max("score"), 6).alias("best_score"), F.round(F.sum("s"), 4).alias("total"))
