"""DuckDB statements equal to the queries of the driver entry, over the same Parquet tables."""

import math

LO, HI = "sqrt(2e0)", "(4e0 - sqrt(2e0))"


def u(tag: str, seed: int, *keys: str) -> str:
    """The hash uniform of the engine."""
    text = " || '|' || ".join(f"({k})::VARCHAR" for k in keys)
    return f"((('0x' || substr(md5('{tag}|{seed}|' || {text}), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0)"


def clamp(v: str) -> str:
    return f"greatest({LO}, least({HI}, {v}))"


def two_rows(gamma: str) -> str:
    """Closed form of a two-row problem: from dr (train draws), tb (test rows) and pr (pairs) to w (weights)."""
    return f"""
    tw AS (SELECT a.tr_bag, a.row_id AS id0, b.row_id AS id1, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1,
             (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM dr a JOIN dr b USING (tr_bag) WHERE a.pos = 0 AND b.pos = 1),
    tg AS (SELECT *, {gamma} AS g FROM tw),
    ks AS (SELECT pr.pair_id, pr.tr_bag, pr.te_bag, count(*) AS nte,
             sum(exp(-g*((x0-z.x)*(x0-z.x)+(y0-z.y)*(y0-z.y)))) AS s0, sum(exp(-g*((x1-z.x)*(x1-z.x)+(y1-z.y)*(y1-z.y)))) AS s1
           FROM pr JOIN tg ON tg.tr_bag = pr.tr_bag JOIN tb z ON z.te_bag = pr.te_bag GROUP BY 1, 2, 3),
    kk AS (SELECT ks.*, id0, id1, exp(-g*d2) AS k, -(2e0/nte)*s0 AS k0, -(2e0/nte)*s1 AS k1 FROM ks JOIN tg USING (tr_bag)),
    sv AS (SELECT *, {clamp('-(k0+k1)/(1e0+k)')} AS s, CASE WHEN k = 1e0 THEN 0e0 ELSE -(k0-k1)/(1e0-k) END AS t FROM kk),
    w AS (SELECT pair_id, tr_bag, te_bag, nte, 0 AS pos, id0 AS row_id,
            CASE WHEN t > s THEN {clamp('-k0')} WHEN t < -s THEN 0e0 ELSE (s+t)/2e0 END AS beta FROM sv
          UNION ALL SELECT pair_id, tr_bag, te_bag, nte, 1, id1,
            CASE WHEN t > s THEN 0e0 WHEN t < -s THEN {clamp('-k1')} ELSE (s-t)/2e0 END FROM sv)"""


class Statements:
    def __init__(self, features, seed: int, rate: float):
        self.features, self.seed, self.rate = features, seed, rate

    def base(self, name: str) -> str:
        key, (x, y) = self.features[name]
        return f"b AS (SELECT {key} AS row_id, ({x})::DOUBLE AS x, ({y})::DOUBLE AS y FROM {name})"

    def split(self, name: str, size: str = "(SELECT count(*) // 5 FROM b)", level: str = "", reverse: bool = False) -> str:
        """b (rows), tr (train with true_beta, idx) and te (test with idx)."""
        keys = ["1", "row_id"] if level else ["row_id"]
        size = f"((SELECT count(*) FROM b) - {size})" if reverse else size
        return f"""{self.base(name)},
        mid AS (SELECT avg(x) AS mx, avg(y) AS my FROM b),
        ds AS (SELECT b.*, (x-mx)*(x-mx)+(y-my)*(y-my) AS d2 FROM b, mid),
        sd AS (SELECT stddev_pop(d2) AS std FROM ds),
        ck AS (SELECT ds.*, exp(d2/std) AS true_beta, ln(-ln({u('clock', self.seed, *keys)})) + d2/std AS clk FROM ds, sd),
        rk AS (SELECT *, row_number() OVER (ORDER BY clk, row_id) AS rn FROM ck),
        tr AS (SELECT row_id, x, y, true_beta, row_number() OVER (ORDER BY row_id) - 1 AS idx FROM rk WHERE rn <= {size}),
        te AS (SELECT row_id, x, y, row_number() OVER (ORDER BY row_id) - 1 AS idx FROM rk WHERE rn > {size}),
        ntr AS (SELECT count(*) AS n FROM tr), nte AS (SELECT count(*) AS n FROM te)"""

    def sides(self) -> str:
        return """SELECT row_id, 'train' AS side, round(true_beta, 4) AS true_beta FROM tr
                  UNION ALL SELECT row_id, 'test', NULL FROM te"""

    # Bags as relations; dr holds train draws, tb test rows.
    def cut(self, out: str, bag: str, side: str, size: str, count: str = "1000000000") -> str:
        return f"""{out} AS (SELECT (idx // {size})::INT AS {bag}, (idx % {size})::INT AS pos, row_id, x, y FROM {side}
                   WHERE idx // {size} < {count})"""

    def boot(self, out: str, bag: str, side: str, size: str, count: str, tag: str) -> str:
        return f"""{out} AS (SELECT d.bag AS {bag}, d.pos, {side}.row_id, x, y FROM
            (SELECT bag, pos, floor({u(tag, self.seed, 'bag', 'pos')} * (SELECT count(*) FROM {side}))::BIGINT AS rank0 FROM
              (SELECT (i // ({size}))::INT AS bag, (i % ({size}))::INT AS pos FROM
                (SELECT unnest(range(({count}) * ({size}))) AS i))) d JOIN {side} ON {side}.idx = d.rank0)"""

    def mixed(self, out: str, bag: str, side: str, size: str, tag: str) -> str:
        return f"""{out} AS (SELECT (rank0 // ({size}))::INT AS {bag}, (rank0 % ({size}))::INT AS pos, row_id, x, y FROM
            (SELECT *, row_number() OVER (ORDER BY {u(tag, self.seed, 'row_id')}, row_id) - 1 AS rank0 FROM {side}))"""

    def whole(self, out: str, bag: str, side: str) -> str:
        return f"{out} AS (SELECT 0 AS {bag}, idx::INT AS pos, row_id, x, y FROM {side})"

    def pairs(self) -> str:
        return """pr AS (SELECT a.tr_bag::BIGINT * (SELECT count(DISTINCT te_bag) FROM tb) + b.te_bag AS pair_id, a.tr_bag, b.te_bag
            FROM (SELECT DISTINCT tr_bag FROM dr) a, (SELECT DISTINCT te_bag FROM tb) b)"""

    def ranked(self, m: str, x: str, k: str) -> str:
        def side(n: str, count: str) -> str:
            return f"""(SELECT i::INT AS {n}_bag, row_number() OVER (ORDER BY {u(f'pair-{n}', self.seed, 'i')}, i) - 1 AS pair_id
                        FROM (SELECT unnest(range({count})) AS i))"""

        return f"pr AS (SELECT pair_id, tr_bag, te_bag FROM {side('tr', m)} JOIN {side('te', x)} USING (pair_id) WHERE pair_id < {k})"

    def width(self) -> str:
        return """gw AS (SELECT median(sqrt((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y))) AS g
            FROM tr a JOIN tr c ON a.idx < c.idx)"""

    GLOBAL = "(SELECT g FROM gw)"
    OWN = "sqrt(d2)"

    def score(self, source: str, keys: str = "") -> str:
        """Scaled score of (keys, beta, true_beta) by its definition."""
        by = f"PARTITION BY {keys}" if keys else ""
        return f"""SELECT {keys + ',' if keys else ''} count(*) AS rows,
              round(avg((sb - st) * (sb - st)) * count(*) * count(*), 5) AS nmse
            FROM (SELECT *, beta / sum(beta) OVER ({by}) AS sb, true_beta / sum(true_beta) OVER ({by}) AS st FROM {source})
            {'GROUP BY ' + keys if keys else ''}"""

    def gradients(self) -> str:
        return f"""WITH {self.split('part')}, {self.cut('dr', 'tr_bag', 'tr', '40', '(SELECT n // 40 FROM ntr)')},
          db AS (SELECT dr.*, 0.5e0 + {u('beta', self.seed, 'row_id')} AS beta FROM dr),
          gg AS (SELECT a.tr_bag, median(sqrt((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y))) AS g
                 FROM dr a JOIN dr c ON a.tr_bag = c.tr_bag AND a.pos < c.pos GROUP BY 1),
          ka AS (SELECT dr.tr_bag, dr.pos, -(40e0 / count(*)) * sum(exp(-g*((dr.x-z.x)*(dr.x-z.x)+(dr.y-z.y)*(dr.y-z.y)))) AS kappa
                 FROM dr JOIN gg USING (tr_bag), te z GROUP BY 1, 2),
          kb AS (SELECT a.tr_bag, a.pos, any_value(a.row_id) AS row_id, any_value(a.beta) AS beta,
                   sum(c.beta * exp(-g*((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)))) AS kbeta
                 FROM db a JOIN db c USING (tr_bag) JOIN gg USING (tr_bag) GROUP BY 1, 2),
          gr AS (SELECT kb.*, kappa, kbeta + kappa AS grad,
                   least(1000e0, greatest(0e0, beta - {self.rate}e0 * (kbeta + kappa))) AS moved FROM kb JOIN ka USING (tr_bag, pos))"""


def statements(features, seed: int, rate: float) -> dict[str, str]:
    s = Statements(features, seed, rate)
    emb = "SELECT vec_id AS row_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings"
    ev = f"SELECT event_id AS row_id, ({features['events'][1][0]})::DOUBLE AS x, ({features['events'][1][1]})::DOUBLE AS y, event_type AS label FROM events"
    out: dict[str, str] = {}

    out["read_arff"] = f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS idx, label, round(x, 8) AS x, round(y, 8) AS y FROM ({ev})"
    out["read_sparse"] = f"""SELECT row_number() OVER (ORDER BY row_id) - 1 AS idx, label, n, last, total FROM
        (SELECT row_id, any_value(label)::VARCHAR AS label, (count(*) FILTER (v > 0))::INT AS n,
           (max(pos) FILTER (v > 0))::INT AS last, round(sum(v) FILTER (v > 0), 5) AS total FROM ({emb}) GROUP BY row_id)"""
    out["first_n"] = out["read_arff"] + " ORDER BY row_id LIMIT 2000"
    out["encode_label"] = """WITH f AS (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1),
        c AS (SELECT event_type, (row_number() OVER (ORDER BY first) - 1)::DOUBLE AS label_code FROM f)
        SELECT event_id AS row_id, event_type AS label, label_code FROM events JOIN c USING (event_type)"""
    out["feature_width"] = f"""SELECT 'dense' AS form, max(len(embedding))::INT AS width FROM embeddings
        UNION ALL SELECT 'sparse', (max(pos) + 1)::INT FROM ({emb}) WHERE v > 0"""
    out["densify"] = f"SELECT row_id, pos::INT AS pos, round(greatest(v, 0e0), 6) AS v FROM ({emb})"
    out["project_features"] = f"WITH {s.base('part')} SELECT row_id, round(x, 8) AS x, round(y, 8) AS y FROM b"
    out["split_round_trip"] = f"""WITH {s.split('customer')}
        SELECT 'train' AS side, row_id, round(x, 8) AS x, round(true_beta, 4) AS true_beta FROM tr
        UNION ALL SELECT 'test', row_id, round(x, 8), NULL FROM te"""
    out["append_report"] = """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, run FROM events,
        (SELECT unnest([1, 2])::INT AS run) GROUP BY event_type, run"""
    out["write_column"] = f"WITH {s.split('customer')} SELECT round(true_beta, 4) AS beta FROM tr"

    out["row_index"] = f"WITH {s.base('orders')} SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS idx FROM b"
    out["mean_vector"] = f"SELECT pos::INT AS pos, round(sum(v) / count(*), 6) AS mean FROM ({emb}) GROUP BY pos"
    out["sq_distance"] = f"""WITH v AS ({emb}) SELECT a.row_id, round(sum((a.v - c.v) * (a.v - c.v)), 6) AS d2
        FROM v a JOIN v c ON a.row_id = c.row_id AND a.pos = 63 - c.pos GROUP BY 1"""
    spread = f"""WITH {s.base('orders')}, mid AS (SELECT avg(x) AS mx, avg(y) AS my FROM b),
        ds AS (SELECT row_id, (x-mx)*(x-mx)+(y-my)*(y-my) AS d2 FROM b, mid), sd AS (SELECT stddev_pop(d2) AS std FROM ds)"""
    out["dispersion"] = f"{spread} SELECT round(std, 6) AS std FROM sd"
    out["accept_prob"] = f"{spread} SELECT row_id, round(d2, 6) AS d2, round(exp(-d2/std), 6) AS p FROM ds, sd"
    dist = "sqrt((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y))"
    out["kernel_width"] = f"WITH {s.base('part')} SELECT round(median({dist}), 6) AS gamma FROM b a JOIN b c ON a.row_id < c.row_id"
    out["kernel_width_selected"] = f"WITH {s.base('customer')} SELECT round(median({dist}), 6) AS gamma FROM b a JOIN b c ON a.row_id < c.row_id"
    ix = "i AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS idx FROM b)"
    out["kernel_width_bags"] = f"""WITH {s.base('part')}, {ix}, {s.boot('d', 'bag_id', 'i', '40', '50', 'boot')}
        SELECT a.bag_id, round(median({dist}), 6) AS gamma FROM d a JOIN d c ON a.bag_id = c.bag_id AND a.pos < c.pos GROUP BY 1"""

    out["biased_split"] = f"WITH {s.split('orders')} {s.sides()}"
    out["reverse_split"] = f"WITH {s.split('orders', reverse=True)} {s.sides()}"
    out["escalated_split"] = f"WITH {s.split('part', level='1')} {s.sides()}"
    out["escalated_split_levels"] = "SELECT 3::BIGINT AS train_rows, count(*) - 3 AS test_rows, TRUE AS weights_ok FROM part"
    out["test_remainder"] = f"WITH {s.split('customer')} SELECT row_id, round(x, 8) AS x, round(y, 8) AS y FROM te"

    out["resolve_bags"] = """WITH t AS (SELECT count(*) AS n FROM orders)
        SELECT n, 400::BIGINT AS bag_size, 7::BIGINT AS bag_count, 0 AS case_id FROM t UNION ALL SELECT n, 400, n // 400, 1 FROM t
        UNION ALL SELECT n, n // 7, 7, 2 FROM t UNION ALL SELECT n, n, 1, 3 FROM t"""
    o = f"WITH {s.base('orders')}, {ix}"
    out["partition_bags"] = f"{o}, {s.cut('d', 'bag_id', 'i', '400', '(SELECT count(*) // 400 FROM b)')} SELECT bag_id, pos, row_id FROM d"
    out["partition_bags_keep"] = f"{o}, {s.cut('d', 'bag_id', 'i', '400')} SELECT bag_id, pos, row_id FROM d"
    out["bootstrap_bags"] = f"{o}, {s.boot('d', 'bag_id', 'i', '300', '20', 'boot')} SELECT bag_id, pos, row_id FROM d"
    out["random_disjoint"] = f"{o}, {s.mixed('d', 'bag_id', 'i', '400', 'disjoint')} SELECT bag_id, pos, row_id FROM d"
    out["gather"] = f"{o}, {s.mixed('d', 'bag_id', 'i', '400', 'disjoint')} SELECT bag_id, pos, row_id, round(x, 8) AS x, round(y, 8) AS y FROM d"
    out["coverage_count"] = """SELECT count(*) AS n, ceil(log10(0.01e0) / (400 * log10(1e0 - 1e0 / count(*))))::BIGINT AS bags FROM orders"""
    mx = "(SELECT count(*) // 400 FROM orders)", "(SELECT count(*) // 900 FROM orders)"
    out["cartesian_pairs"] = f"""SELECT i AS pair_id, (i // {mx[1]})::INT AS tr_bag, (i % {mx[1]})::INT AS te_bag
        FROM (SELECT unnest(range({mx[0]} * {mx[1]})) AS i)"""
    out["random_pairs"] = f"WITH {s.ranked(*mx, f'least({mx[0]}, {mx[1]})')} SELECT pair_id, tr_bag, te_bag FROM pr"
    m, x = "(SELECT n // 30 FROM ntr)", "(SELECT n // 4 FROM nte)"
    strategies = {
        1: (s.boot("dr", "tr_bag", "tr", "30", m, "boot-train"), s.cut("tb", "te_bag", "te", x, "4"), s.pairs()),
        2: (s.cut("dr", "tr_bag", "tr", "30", m), s.boot("tb", "te_bag", "te", x, "4", "boot-test"), s.pairs()),
        3: (s.boot("dr", "tr_bag", "tr", "30", m, "boot-train"), s.boot("tb", "te_bag", "te", x, "4", "boot-test"), s.pairs()),
        4: (s.boot("dr", "tr_bag", "tr", "30", m, "boot-train"), s.boot("tb", "te_bag", "te", x, "4", "boot-test"), s.ranked(m, "4", f"least({m}, 4)")),
    }
    for mode, (dr, tb, pr) in strategies.items():
        out[f"bag_strategy_{mode}"] = f"""WITH {s.split('part')}, {dr}, {tb}, {pr}
            SELECT pair_id, tr_bag, te_bag, tr_check, te_check FROM pr
            JOIN (SELECT tr_bag, sum((pos+1)*row_id)::BIGINT AS tr_check FROM dr GROUP BY 1) USING (tr_bag)
            JOIN (SELECT te_bag, sum((pos+1)*row_id)::BIGINT AS te_check FROM tb GROUP BY 1) USING (te_bag)"""

    out["gram"] = f"""WITH {s.base('part')}, {ix}, {s.cut('d', 'bag_id', 'i', '50', '(SELECT count(*) // 50 FROM b)')},
        g AS (SELECT a.bag_id, median({dist}) AS g FROM d a JOIN d c ON a.bag_id = c.bag_id AND a.pos < c.pos GROUP BY 1),
        k AS (SELECT a.bag_id, a.pos, c.pos AS j, exp(-g*((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y))) AS k
              FROM d a JOIN d c ON a.bag_id = c.bag_id JOIN g ON g.bag_id = a.bag_id)
        SELECT bag_id, pos, count(*)::INT AS n, round(sum(k), 5) AS total, round(sum(k * (j + 1)), 4) AS moment FROM k GROUP BY 1, 2"""
    kap = f"""WITH {s.split('part')}, {s.width()}, {s.cut('dr', 'tr_bag', 'tr', '40', '(SELECT n // 40 FROM ntr)')},
        {s.mixed('tb', 'te_bag', 'te', 'SELECT (n + 2) // 3 FROM nte', 'disjoint')}, {s.pairs()},
        gg AS (SELECT a.tr_bag, median({dist}) AS g FROM dr a JOIN dr c ON a.tr_bag = c.tr_bag AND a.pos < c.pos GROUP BY 1),
        k AS (SELECT pair_id, pr.tr_bag, pr.te_bag, dr.pos, dr.row_id,
          -(40e0 / count(*)) * sum(exp(-(GAMMA)*((dr.x-z.x)*(dr.x-z.x)+(dr.y-z.y)*(dr.y-z.y)))) AS kappa
          FROM pr JOIN dr ON dr.tr_bag = pr.tr_bag JOIN gg ON gg.tr_bag = pr.tr_bag JOIN tb z ON z.te_bag = pr.te_bag GROUP BY 1, 2, 3, 4, 5)
        SELECT pair_id, tr_bag, te_bag, pos, row_id, round(kappa, 5) AS kappa FROM k"""
    out["kappa"] = kap.replace("GAMMA", "gg.g")
    out["kappa_global"] = kap.replace("GAMMA", "SELECT g FROM gw")
    out["kmm_bounds"] = f"""{o}, {s.mixed('d', 'bag_id', 'i', '400', 'disjoint')}, c AS (SELECT bag_id, count(*) AS n FROM d GROUP BY 1)
        SELECT bag_id, n, round((sqrt(n)-1)/sqrt(n), 6) AS eps, round(sqrt(n), 6) AS sum_lo, round(2*n - sqrt(n), 6) AS sum_hi, 1000e0 AS box FROM c"""
    out["kmm_step"] = f"{s.gradients()} SELECT tr_bag AS bag_id, pos, row_id, round(moved, 6) AS beta FROM gr"
    out["kmm_objective"] = f"""{s.gradients()} SELECT tr_bag AS bag_id, round(sum(beta * (0.5e0 * kbeta + kappa)), 5) AS objective FROM gr GROUP BY 1"""
    # The step is small enough that its sum stays inside the allowed range, where projecting is clipping.
    out["kmm_residual"] = f"""{s.gradients()} SELECT tr_bag AS bag_id,
        CASE WHEN sum(moved) BETWEEN sqrt(40e0) AND 80 - sqrt(40e0) THEN round(max(abs(beta - moved)), 6) END AS residual FROM gr GROUP BY 1"""

    two = f"""WITH {s.split('part')}, {s.width()}, {s.cut('dr', 'tr_bag', 'tr', '2', '(SELECT n // 2 FROM ntr)')},
        {s.cut('tb', 'te_bag', 'te', '(SELECT (n + 1) // 2 FROM nte)', '2')}, {s.pairs()}, """
    sel = " SELECT pair_id, tr_bag, te_bag, pos, row_id, round(beta, 6) AS beta FROM w"
    out["kmm_bags"] = two + two_rows(s.GLOBAL) + sel
    out["bag_weights"] = two + two_rows(s.OWN) + sel
    out["bag_weights_large"] = """WITH t AS (SELECT count(*) // 5 // 100 AS m FROM orders)
        SELECT i AS pair_id, (i // 3)::INT AS tr_bag, (i % 3)::INT AS te_bag, 100::BIGINT AS n, TRUE AS feasible, TRUE AS optimal
        FROM (SELECT unnest(range((SELECT m FROM t) * 3)) AS i)"""
    pair = f"WITH {s.split('part', '2')}, {s.width()}, {s.whole('dr', 'tr_bag', 'tr')}"
    out["kmm_whole_two"] = f"""{pair}, {s.whole('tb', 'te_bag', 'te')}, {s.pairs()}, {two_rows(s.GLOBAL)}
        SELECT row_id, round(beta, 6) AS beta FROM w"""
    out["kmm_whole"] = "SELECT count(*) // 5 AS n, TRUE AS feasible, TRUE AS converged FROM part"
    out["kmm_whole_iterated"] = "SELECT count(*) // 5 AS n, TRUE AS feasible, TRUE AS converged, TRUE AS optimum FROM supplier"

    sparse = f"""WITH e AS (SELECT vec_id AS row_id, unnest(range(64)) AS pos, greatest(unnest(embedding)::DOUBLE, 0e0) AS v FROM embeddings),
        m AS (SELECT pos, avg(v) AS mean FROM e GROUP BY 1)"""
    out["mean_vector_sparse"] = f"{sparse} SELECT pos::INT AS pos, round(mean, 6) AS mean FROM m WHERE mean > 0"
    out["biased_split_sparse"] = f"""{sparse}, ds AS (SELECT row_id, sum((v-mean)*(v-mean)) AS d2 FROM e JOIN m USING (pos) GROUP BY 1),
        sd AS (SELECT stddev_pop(d2) AS std FROM ds),
        rk AS (SELECT row_id, exp(d2/std) AS true_beta,
                 row_number() OVER (ORDER BY ln(-ln({u('clock', seed, 'row_id')})) + d2/std, row_id) AS rn FROM ds, sd)
        SELECT row_id, CASE WHEN rn <= (SELECT count(*) // 5 FROM ds) THEN 'train' ELSE 'test' END AS side,
          CASE WHEN rn <= (SELECT count(*) // 5 FROM ds) THEN round(true_beta, 4) END AS true_beta FROM rk"""

    # Distances of sparse rows, whose missing entries are zeros.
    apart = "sqrt(sum((a.v - c.v) * (a.v - c.v)))"
    placed = f"{sparse}, r AS (SELECT *, dense_rank() OVER (ORDER BY row_id) - 1 AS idx FROM e), t AS (SELECT count(*) // 64 AS n FROM e)"
    out["kernel_width_sparse"] = f"""{sparse}, d AS (SELECT {apart} AS d FROM e a JOIN e c ON a.pos = c.pos AND a.row_id < c.row_id GROUP BY a.row_id, c.row_id)
        SELECT round(median(d), 6) AS gamma FROM d"""
    def bagged(size: int) -> str:
        return f"""{placed}, d AS (SELECT (idx // {size})::INT AS bag_id, (idx % {size})::INT AS spot, row_id, pos, v FROM r WHERE idx // {size} < (SELECT n // {size} FROM t)),
        g AS (SELECT bag_id, median(d) AS g FROM (SELECT a.bag_id, {apart} AS d FROM d a JOIN d c ON a.bag_id = c.bag_id AND a.pos = c.pos AND a.spot < c.spot
              GROUP BY a.bag_id, a.spot, c.spot) GROUP BY 1)"""

    out["gram_sparse"] = f"""{bagged(50)}, k AS (SELECT bag_id, a.spot, c.spot AS j, sum((a.v - c.v) * (a.v - c.v)) AS d2 FROM d a JOIN d c USING (bag_id, pos) GROUP BY 1, 2, 3)
        SELECT bag_id, spot AS pos, count(*)::INT AS n, round(sum(exp(-g * d2)), 5) AS total, round(sum(exp(-g * d2) * (j + 1)), 4) AS moment
        FROM k JOIN g USING (bag_id) GROUP BY 1, 2"""
    out["kappa_sparse"] = f"""{bagged(40)},
        ids AS (SELECT DISTINCT row_id FROM e), mx AS (SELECT row_id, row_number() OVER (ORDER BY {u('disjoint', seed, 'row_id')}, row_id) - 1 AS rank0 FROM ids),
        tb AS (SELECT (rank0 // ((n + 2) // 3))::INT AS te_bag, e.row_id, pos, v FROM mx JOIN e USING (row_id), t),
        x AS (SELECT d.bag_id, d.spot, any_value(d.row_id) AS row_id, te_bag, tb.row_id AS other, sum((d.v - tb.v) * (d.v - tb.v)) AS d2 FROM d JOIN tb USING (pos) GROUP BY d.bag_id, d.spot, te_bag, tb.row_id)
        SELECT bag_id::BIGINT * 3 + te_bag AS pair_id, bag_id AS tr_bag, te_bag, spot AS pos, row_id, round(-(40e0 / count(*)) * sum(exp(-g * d2)), 5) AS kappa
        FROM x JOIN g USING (bag_id) GROUP BY bag_id, te_bag, spot, row_id"""
    draws, away = 20_000, 3.29 * 20_000**0.5 / 2
    ends = [0.5, math.floor((draws - 1) / 2 - away) / (draws - 1), math.ceil((draws - 1) / 2 + away) / (draws - 1)]
    out["kernel_width_sampled"] = f"""WITH {s.base('part')}, {ix}, n AS (SELECT count(*) AS n FROM b),
        p AS (SELECT draw, floor({u('width-a', seed, 'draw')} * n)::BIGINT AS i, floor({u('width-b', seed, 'draw')} * (n - 1))::BIGINT AS j FROM (SELECT unnest(range({draws})) AS draw), n),
        d AS (SELECT {dist} AS d FROM p JOIN i a ON a.idx = p.i JOIN i c ON c.idx = p.j + (p.j >= p.i)::INT)
        SELECT {', '.join(f'round(quantile_cont(d, {q!r}), 6) AS {c}' for q, c in zip(ends, ('gamma', 'low', 'high')))}, {draws}::BIGINT AS pairs, FALSE AS exact FROM d"""
    out["bag_weights_together"] = """WITH n AS (SELECT count(*) // 5 AS tr, count(*) - count(*) // 5 AS te FROM supplier)
        SELECT i::INT AS bag_id, tr AS n, TRUE AS feasible, TRUE AS optimum FROM n, (SELECT unnest(range(8)) AS i) WHERE i < (te + (te + 7) // 8 - 1) // ((te + 7) // 8)"""
    out["append_report_runs"] = """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, run FROM events,
        (SELECT unnest(['1', '2']) AS run) GROUP BY event_type, run"""

    out["mean_weights"] = "SELECT l_orderkey AS row_id, round(avg(l_quantity), 6) AS beta FROM lineitem GROUP BY 1"
    shared = "SELECT row_id, round(sum(beta * nte) / (SELECT n FROM nte), 6) AS beta FROM w GROUP BY 1"
    mean = " SELECT row_id, round(avg(beta), 6) AS beta FROM w GROUP BY 1"
    out["test_split_weights"] = f"""{pair}, {s.mixed('tb', 'te_bag', 'te', 'SELECT n // 4 FROM nte', 'split-test')}, {s.pairs()},
        {two_rows(s.GLOBAL)} {shared}"""
    full = f"WITH {s.split('part')}, {s.width()}"
    out["train_split_weights"] = f"""{full}, {s.mixed('dr', 'tr_bag', 'tr', '2', 'split-train')}, {s.whole('tb', 'te_bag', 'te')}, {s.pairs()},
        {two_rows(s.GLOBAL)} SELECT row_id, round(beta / (SELECT sum(beta) FROM w) * (SELECT n FROM ntr), 6) AS beta FROM w"""
    draws = s.boot("dr", "tr_bag", "tr", "2", "SELECT n FROM ntr", "boot-train")
    out["bagged_train_weights"] = f"""{full}, {draws}, {s.whole('tb', 'te_bag', 'te')}, {s.pairs()}, {two_rows(s.GLOBAL)} {mean}"""
    out["bagged_ensemble_weights"] = f"""{full}, {draws}, {s.mixed('tb', 'te_bag', 'te', 'SELECT n // 3 FROM nte', 'split-test')}, {s.pairs()},
        {two_rows(s.GLOBAL)}, v AS (SELECT tr_bag, pos, row_id, sum(beta * nte) / (SELECT n FROM nte) AS beta FROM w GROUP BY 1, 2, 3)
        SELECT row_id, round(avg(beta), 6) AS beta FROM v GROUP BY 1"""
    out["unsampled_rows"] = f"{o}, {s.boot('d', 'bag_id', 'i', '300', '20', 'boot')} SELECT row_id FROM b WHERE row_id NOT IN (SELECT row_id FROM d)"

    quarter, half = "(SELECT n // 4 FROM ntr)", "(SELECT n // 2 FROM ntr)"
    third = "(SELECT n // 3 FROM nte)"
    te_boot = s.boot("tb", "te_bag", "te", third, "3", "boot-test")
    modes = {
        1: (s.boot("dr", "tr_bag", "tr", "2", quarter, "boot-train"), s.cut("tb", "te_bag", "te", "(SELECT n // 3 FROM nte)", "3"), s.pairs()),
        2: (s.cut("dr", "tr_bag", "tr", "2", half), te_boot, s.pairs()),
        3: (s.boot("dr", "tr_bag", "tr", "2", quarter, "boot-train"), te_boot, s.pairs()),
        4: (s.boot("dr", "tr_bag", "tr", "2", half, "boot-train"), te_boot, s.ranked(half, "3", f"least({half}, 3)")),
    }
    for mode, (dr, tb, pr) in modes.items():
        out[f"bagged_kmm_{mode}"] = f"WITH {s.split('part')}, {dr}, {tb}, {pr}, {two_rows(s.OWN)} {mean}"
    covered = "(SELECT ceil(log10(0.01e0) / (100 * log10(1 - 1e0 / n)))::BIGINT FROM ntr)"
    out["flagship"] = f"""WITH {s.split('orders')}, {s.boot('dr', 'tr_bag', 'tr', '100', covered, 'boot-train')}
        SELECT row_id, round(true_beta, 4) AS true_beta, TRUE AS weighted FROM tr WHERE row_id IN (SELECT row_id FROM dr)"""
    out["bagged_kmm_orders"] = f"""WITH {s.split('orders')} SELECT row_id, TRUE AS feasible FROM tr WHERE idx < (SELECT n // 100 * 100 FROM ntr)"""
    out["test_ensemble_kmm"] = f"""{pair}, {s.cut('tb', 'te_bag', 'te', '(SELECT n // 3 FROM nte)', '3')}, {s.pairs()}, {two_rows(s.GLOBAL)} {mean}"""

    est = f"""WITH {s.split('customer')}, e AS (SELECT row_id, abs(c_acctbal) + 1e0 AS beta, true_beta, c_nationkey
        FROM tr JOIN customer ON c_custkey = row_id)"""
    out["align_truth"] = f"{est} SELECT row_id, round(beta, 6) AS beta, round(true_beta, 4) AS true_beta FROM e"
    out["nmse"] = f"{est} {s.score('e', 'c_nationkey')}"
    out["run_stats"] = f"""WITH {s.split('part')}, {s.cut('dr', 'tr_bag', 'tr', '2', half)}, {te_boot}, {s.pairs()}, {two_rows(s.OWN)},
        a AS (SELECT row_id, avg(beta) AS beta FROM w GROUP BY 1),
        j AS (SELECT beta / sum(beta) OVER () AS sb, true_beta / sum(true_beta) OVER () AS st FROM a JOIN tr USING (row_id))
        SELECT 'bagged' AS method, 2 AS mode, (SELECT n FROM ntr) AS train_rows, (SELECT n FROM nte) AS test_rows,
          2::BIGINT AS tr_bag_size, {half} AS tr_bags, {third} AS te_bag_size, 3::BIGINT AS te_bags, (SELECT n % 2 FROM ntr) AS train_left_out, 0::BIGINT AS test_left_out, TRUE AS timed,
          round(avg((sb-st)*(sb-st)) * (SELECT n FROM ntr) * (SELECT n FROM ntr), 4) AS nmse FROM j"""

    def two_stats(method: str, cut: str, te_size: str, te_bags: str, left: str) -> str:
        return f"""{pair}, {cut}, {s.pairs()}, {two_rows(s.GLOBAL)}, a AS (SELECT row_id, avg(beta) AS beta FROM w GROUP BY 1),
        j AS (SELECT beta / sum(beta) OVER () AS sb, true_beta / sum(true_beta) OVER () AS st FROM a JOIN tr USING (row_id))
        SELECT '{method}' AS method, 2::BIGINT AS train_rows, (SELECT n FROM nte) AS test_rows, 2::BIGINT AS tr_bag_size,
          1::BIGINT AS tr_bags, {te_size} AS te_bag_size, {te_bags}::BIGINT AS te_bags, 0::BIGINT AS train_left_out,
          {left} AS test_left_out, TRUE AS timed, round(avg((sb-st)*(sb-st)) * 4, 4) AS nmse FROM j"""

    out["run_stats_whole"] = two_stats("whole", s.whole("tb", "te_bag", "te"), "(SELECT n FROM nte)", "1", "0::BIGINT")
    out["run_stats_test_ensemble"] = two_stats("test_ensemble", s.cut("tb", "te_bag", "te", third, "3"), third, "3", "(SELECT n % 3 FROM nte)")
    # Rows of the file are numbered from 0 in the order of event_id.
    numbered = s.split("events").replace(s.base("events"), s.base("events").replace("event_id AS row_id", "row_number() OVER (ORDER BY event_id) - 1 AS row_id"))
    out["file_to_report"] = f"""WITH {numbered}, {s.cut('dr', 'tr_bag', 'tr', '2', half)}, {te_boot}, {s.pairs()}, {two_rows(s.OWN)},
        a AS (SELECT row_id, avg(beta) AS beta FROM w GROUP BY 1),
        j AS (SELECT beta / sum(beta) OVER () AS sb, true_beta / sum(true_beta) OVER () AS st FROM a JOIN tr USING (row_id))
        SELECT count(*) AS "rows", round(avg((sb-st)*(sb-st)) * count(*) * count(*), 5) AS nmse FROM j"""

    # Bags and splits as large as train: what each method scores, by counts; a bootstrap method scores the rows that it drew.
    whole_n = "(SELECT n FROM ntr)"
    out["compare_methods"] = f"""WITH {s.split('part')}, {s.boot('dr', 'tr_bag', 'tr', whole_n, '5', 'boot-train')},
        m AS (SELECT unnest(['test_split', 'train_split', 'whole']) AS method, {whole_n} AS "rows" UNION ALL
          SELECT unnest(['train_bags', 'train_bags_test_split']), (SELECT count(DISTINCT row_id) FROM dr))
        SELECT method, "rows", TRUE AS scored FROM m"""
    out["sweep"] = """WITH n AS (SELECT count(*) // 5 AS n FROM part),
        ss AS (SELECT 1 AS k, 3 AS s UNION SELECT 1, ceil(-2e0 / (n * log10(1e0 - 1e0 / n)))::INT FROM n)
        SELECT method, k, s, rep, TRUE AS scored, TRUE AS timed FROM ss, (SELECT unnest([0, 1])::INT AS rep),
          (SELECT unnest(['test_split', 'train_split', 'train_bags', 'train_bags_test_split']) AS method)"""
    out["sweep_grid"] = """WITH n AS (SELECT count(*) // 5 AS n FROM part), ks AS (SELECT unnest([4, 8])::INT AS k),
        ss AS (SELECT k, 5 AS s FROM ks UNION SELECT k, ceil(-2e0 / ((n // k) * log10(1e0 - 1e0 / n)))::INT FROM ks, n)
        SELECT method, k, s, rep, TRUE AS scored FROM ss, (SELECT unnest([0, 1])::INT AS rep),
          (SELECT unnest(['test_split', 'train_split', 'train_bags', 'train_bags_test_split']) AS method)"""
    out["run_study"] = """WITH n AS (SELECT least((SELECT count(*) FROM supplier), (SELECT count(*) FROM part)) // 5 AS n),
        ss AS (SELECT 2 AS k, 3 AS s UNION SELECT 2, ceil(-2e0 / ((n // 2) * log10(1e0 - 1e0 / n)))::INT FROM n),
        m AS (SELECT method, k, s FROM ss, (SELECT unnest(['test_split', 'train_split', 'train_bags', 'train_bags_test_split']) AS method) UNION ALL SELECT 'whole', 1, 0)
        SELECT dataset, method, k, s, rep, TRUE AS scored, TRUE AS timed FROM m, (SELECT unnest(['supplier', 'part']) AS dataset), (SELECT unnest([0, 1])::INT AS rep)"""
    # Whole tables as train: what must hold of the weights, which the queries check one by one.
    fifth = "(SELECT count(*) // 5 FROM part)"
    for name in ("test_split_weights_table", "test_ensemble_kmm_table"):
        out[name] = f"SELECT {fifth} AS n, {fifth} AS ids, TRUE AS feasible"
    for name in ("run_stats_whole_table", "run_stats_test_ensemble_table"):
        out[name] = f"SELECT {fifth} AS train_rows, TRUE AS scored"
    out["compare_methods_table"] = "SELECT unnest(['test_split', 'train_split', 'train_bags', 'train_bags_test_split', 'whole']) AS method, TRUE AS scored"
    for mode in (2, 3, 4):
        out[f"bagged_kmm_{mode}_table"] = "SELECT TRUE AS weighted, TRUE AS feasible, TRUE AS once"
    out["study_report"] = """SELECT l_returnflag AS dataset, l_linestatus AS method, l_linenumber AS k, l_quantity::INT AS s,
        round(avg(l_discount), 6) AS nmse, round(avg(l_tax), 6) AS seconds FROM lineitem GROUP BY 1, 2, 3, 4"""
    return out
