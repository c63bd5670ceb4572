"""Small fixtures with hand-written expectations for the SQL front end."""

from decimal import Decimal

import pytest

from lakeloom.plans.engine import Engine
from lakeloom.plans.quantified import rewrite, spread_not_in
from lakeloom.plans.strict import SqlError, UnsupportedSql


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('tables')}")
    for name, columns, rows in (
        ("ships", "id INTEGER PRIMARY KEY, hull TEXT, crew INTEGER", "(7,'Brigg',12),(9,'Kogge',30),(11,'Barke',18),(14,'Ewer',4),(20,'Prahm',NULL)"),
        ("codes", "id INTEGER PRIMARY KEY, c TEXT", "(1,'q%7'),(2,'q57'),(3,'r_7'),(4,'rx7')"),
        ("catches", "id INTEGER PRIMARY KEY, port TEXT, tons REAL, boxes INTEGER", "(1,'Husum',2.5,8),(2,'Husum',4.5,NULL),(3,'Emden',1.25,3),(4,'Emden',0.75,NULL),(5,'Emden',6,41)"),
        ("sailors", "id INTEGER PRIMARY KEY, who TEXT, ship TEXT, pay INTEGER", "(1,'Imke','Brigg',70),(2,'Onno','Kogge',90),(3,'Telse','Barke',65),(4,'Wiebe',NULL,40),(5,'Hauke','Brigg',NULL),(6,'Geske','Ewer',55)"),
        ("docks", "hull TEXT PRIMARY KEY, berth INTEGER", "('Brigg',3),('Barke',8),('Prahm',NULL)"),
        ("bag_a", "id INTEGER PRIMARY KEY, v INTEGER", "(1,4),(2,4),(3,6),(4,6),(5,6),(6,9)"),
        ("bag_b", "id INTEGER PRIMARY KEY, v INTEGER", "(1,6),(2,6),(3,4),(4,11)"),
        ("depths", "id INTEGER PRIMARY KEY, m INTEGER", "(1,2),(2,NULL),(3,13)"),
        ("texts", "id INTEGER PRIMARY KEY, t TEXT", "(1,' 12'),(2,'3.9'),(3,'rope'),(4,NULL)"),
    ):
        e.execute(f"CREATE TABLE {name} ({columns})")
        e.execute(f"INSERT INTO {name} VALUES {rows}")
    return e


def values(db, sql):
    return sorted((tuple(r.values()) for r in db.execute(sql)), key=repr)


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT id FROM ships WHERE crew < 30 AND crew <> 12", [(11,), (14,)]),
        ("SELECT id FROM ships WHERE NOT (crew > 5 OR hull = 'Ewer')", []),
        ("SELECT id FROM ships WHERE crew NOT IN (4, 18)", [(7,), (9,)]),
        ("SELECT id FROM ships WHERE crew NOT IN (4, NULL)", []),
        ("SELECT id FROM ships WHERE crew IS NULL", [(20,)]),
        ("SELECT id FROM ships WHERE hull ILIKE 'b%' OR hull LIKE '_wer'", [(7,), (11,), (14,)]),
        ("SELECT id FROM ships WHERE crew BETWEEN 12 AND 18", [(7,), (11,)]),
        ("SELECT id FROM codes WHERE c LIKE 'q#%7' ESCAPE '#'", [(1,)]),
        ("SELECT id FROM codes WHERE c LIKE 'r#_7' ESCAPE '#'", [(3,)]),
        ("SELECT port, count(*) AS n, sum(tons) AS s FROM catches GROUP BY port", [("Emden", 3, 8.0), ("Husum", 2, 7.0)]),
        ("SELECT port FROM catches GROUP BY port HAVING sum(boxes) > 20", [("Emden",)]),
        ("SELECT count(*) AS n, sum(tons) AS s FROM catches WHERE tons < 0", [(0, None)]),
        ("SELECT port, count(*) AS n FROM catches WHERE tons < 0 GROUP BY port", []),
        ("SELECT who, berth FROM sailors LEFT JOIN docks ON ship = hull WHERE pay > 60", [("Imke", 3), ("Onno", None), ("Telse", 8)]),
        ("SELECT who, berth FROM sailors FULL JOIN docks ON ship = hull WHERE who IS NULL OR berth = 3", [("Hauke", 3), ("Imke", 3), (None, None)]),
        ("SELECT v FROM bag_a INTERSECT ALL SELECT v FROM bag_b", [(4,), (6,), (6,)]),
        ("SELECT v FROM bag_a EXCEPT ALL SELECT v FROM bag_b", [(4,), (6,), (9,)]),
        ("SELECT v FROM bag_a EXCEPT SELECT v FROM bag_b", [(9,)]),
        ("SELECT who FROM sailors WHERE ship IN (SELECT hull FROM docks WHERE berth < 5)", [("Hauke",), ("Imke",)]),
        ("SELECT who FROM sailors WHERE pay > (SELECT avg(pay) FROM sailors)", [("Imke",), ("Onno",), ("Telse",)]),
        ("SELECT who FROM sailors WHERE pay > ALL (SELECT pay FROM sailors WHERE ship = 'Barke')", [("Imke",), ("Onno",)]),
        ("SELECT who FROM sailors WHERE pay >= ANY (SELECT pay FROM sailors WHERE ship = 'Barke')", [("Imke",), ("Onno",), ("Telse",)]),
        ("SELECT who FROM sailors WHERE pay < ALL (SELECT pay FROM sailors WHERE ship = 'Raft') AND id < 3", [("Imke",), ("Onno",)]),
        ("SELECT who FROM sailors WHERE pay <> ALL (SELECT m FROM depths)", []),
        ("SELECT who FROM sailors WHERE pay / 10 + 0 = SOME (SELECT 9)", [("Onno",)]),
        # values of dynamically typed SQL
        ("SELECT id, crew / (id - 7) AS q FROM ships WHERE id < 10", [(7, None), (9, 15.0)]),
        ("SELECT trim('\t a b \n') AS t, round(2.5) AS r, round(-2.5) AS n, round(1.25, 1) AS d FROM ships WHERE id = 7", [("a b", 3, -3, Decimal("1.3"))]),
        ("SELECT id, CAST(t AS INTEGER) AS i FROM texts", [(1, 12), (2, 3), (3, None), (4, None)]),
        ("SELECT id, t + 1 AS n FROM texts", [(1, 13.0), (2, 4.9), (3, None), (4, None)]),
        ("SELECT ships.id AS s, texts.id AS t FROM ships JOIN texts ON crew = t", [(7, 1)]),
        ("SELECT id, pay = ANY (SELECT m * 5 FROM depths) AS a, 65 <> ALL (SELECT m FROM depths WHERE m IS NOT NULL) AS b FROM sailors WHERE id IN (3, 4, 5)", [(3, True, True), (4, None, True), (5, None, True)]),
    ],
)
def test_expected_rows(db, sql, expected):
    assert values(db, sql) == sorted(expected, key=repr)


@pytest.mark.parametrize(
    "sql",
    ["SELECT port, tons FROM catches GROUP BY port", "SELECT mast FROM ships", "SELECT * FROM wrecks", "SELECT id FROM ships JOIN codes ON ships.id = codes.id", "SELECT id, id FROM ships", "SELECT sum(hull) AS s FROM ships", "SELECT who FROM sailors WHERE pay = (SELECT pay FROM sailors)", "SELECT id FROM ships UNION SELECT id, hull FROM ships", "SELECT id FROM ships ORDER BY 7", "INSERT INTO ships VALUES (9, 'x')", "INSERT INTO ships (id, mast) VALUES (9, 1)", "UPDATE ships SET id = 4 WHERE id = 7", "DELETE FROM ships s WHERE s.id = 7", "UPDATE ships"],
)
def test_errors_are_loud(db, sql):
    with pytest.raises((SqlError, UnsupportedSql)):
        db.execute(sql)


@pytest.mark.parametrize("sql", ["WITH t AS (SELECT 1 AS a) SELECT a FROM t", "SELECT row_number() OVER (ORDER BY id) AS r FROM ships", "SELECT id FROM (SELECT id FROM ships) t", "SELECT stddev(crew) AS s FROM ships", "SELECT substring(hull, 1, 2) AS s FROM ships", "SELECT id FROM ships WHERE EXISTS (SELECT 1 FROM docks WHERE docks.hull = ships.hull)", "SELECT 1 AS a UNION SELECT 2 INTERSECT SELECT 2"])
def test_strict_mode_refuses(spark, db, sql):
    strict = Engine(spark, db.root, strict=True)
    with pytest.raises((SqlError, UnsupportedSql)):
        strict.execute(sql)


@pytest.mark.parametrize("op", ["<", "<=", ">", ">=", "=", "<>"])
@pytest.mark.parametrize("word", ["ANY", "ALL"])
def test_quantified_against_three_valued_logic(spark, op, word):
    import operator

    act = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq, "<>": operator.ne}[op]
    for ys in ([], [1], [None], [1, None], [1, 1], [1, 3, None]):
        source = " UNION ALL ".join(f"SELECT CAST({'NULL' if y is None else y} AS INT) AS y" for y in ys) or "SELECT CAST(1 AS INT) AS y WHERE false"
        for x in (1, 2, None):
            seen = [None if x is None or y is None else act(x, y) for y in ys]
            if word == "ANY":
                want = True if True in seen else (None if None in seen else False)
            else:
                want = False if False in seen else (None if None in seen else True)
            sql = rewrite(f"SELECT count(*) AS n FROM (SELECT CAST({'NULL' if x is None else x} AS INT) AS x) t WHERE x {op} {word} ({source})")
            assert spark.sql(sql).first().n == (1 if want is True else 0), (op, word, ys, x)


def test_not_in_of_a_subquery_is_no_broadcast(spark):
    """the subquery's values went to the driver, whatever their number."""
    from lakeloom import queries

    for name in ("wh_orphans", "sub_not_in", "notin_null_aware"):  # however small the tables are
        plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and "Broadcast" not in plan
    source = lambda vs: " UNION ALL ".join(f"SELECT CAST({'NULL' if v is None else v} AS INT) AS y" for v in vs) or "SELECT CAST(1 AS INT) AS y WHERE false"
    xs = [1, 2, None]
    for ys in ([], [1], [None], [1, None], [3, 3]):
        for clause in ("WHERE x NOT IN ({q})", "WHERE n = 1 AND (t.x + 0 NOT IN ({q})) AND n BETWEEN 1 AND 2 ORDER BY 1"):
            sql = f"SELECT x FROM (SELECT y AS x, 1 AS n FROM ({source(xs)})) t {clause.format(q=source(ys))}"
            made = spread_not_in(sql)
            assert "NOT EXISTS" in made and " NOT IN " not in made
            want = [x for x in xs if not ys or x is not None and None not in ys and x not in ys]
            assert sorted((r.x for r in spark.sql(made).collect()), key=str) == sorted(want, key=str), (ys, clause)


@pytest.mark.parametrize("clause", ["WHERE x NOT IN (1, 2)", "WHERE NOT (x NOT IN (SELECT 1))", "WHERE a OR x NOT IN (SELECT 1)", "WHERE x NOT IN (SELECT 1) IS NULL", "WHERE a = x NOT IN (SELECT 1)", "WHERE (a, b) NOT IN (SELECT 1, 2)", "JOIN u ON x NOT IN (SELECT 1)", "WHERE 'x NOT IN (SELECT 1)' = a"])
def test_not_in_stays_where_null_counts(clause):
    assert spread_not_in(f"SELECT x, a NOT IN (SELECT 2) AS v FROM t {clause}") == f"SELECT x, a NOT IN (SELECT 2) AS v FROM t {clause}"


def test_changes(db):
    e = db
    e.execute("CREATE TABLE stock (id INTEGER PRIMARY KEY, item TEXT, kg INTEGER)")
    assert e.execute("INSERT INTO stock VALUES (1,'tar',40),(2,'hemp',900),(2,'flax',800)") == [{"count": 2}]
    assert values(e, "SELECT * FROM stock") == [(1, "tar", 40), (2, "flax", 800)]  # of equal keys the last
    e.execute("CREATE INDEX by_kg ON stock (kg)")
    assert e.execute("UPDATE stock SET KG = kg + 2, item = concat(item, kg) WHERE kg < 100") == [{"count": 1}]
    assert values(e, "SELECT * FROM stock") == [(1, "tar40", 42), (2, "flax", 800)]
    e.execute("INSERT INTO stock (id, item) SELECT id + 10, item FROM stock")
    assert values(e, "SELECT id, kg FROM stock") == [(1, 42), (11, None), (12, None), (2, 800)]
    assert e.execute("UPDATE stock SET item = :i WHERE id = :n", i="o'; DROP", n=11) == [{"count": 1}]
    assert e.get_many("stock", [11, 99]).select("item").first()[0] == "o'; DROP" and e.exists("stock", 12) and not e.exists("stock", 13)
    assert e.delete("stock", "kg > :most OR kg IS NULL", most=500) == 3
    assert values(e, "SELECT id FROM stock") == [(1,)]
    assert e.analyze("stock")["row_bytes"] == 8.0
    e.execute("DROP TABLE stock")
    with pytest.raises(SqlError):
        e.execute("SELECT * FROM stock")


def test_star_join_keeps_both_of_a_name(db):
    row = db.execute("SELECT * FROM ships JOIN codes ON ships.id = codes.id + 6 WHERE c = 'q%7'")
    assert row == [{"ships.id": 7, "hull": "Brigg", "crew": 12, "codes.id": 1, "c": "q%7"}]


def test_engines_do_not_see_each_others_tables(spark, db, tmp_path):
    db.execute("SELECT id FROM ships")
    other = Engine(spark, f"file://{tmp_path}")
    with pytest.raises(SqlError):
        other.execute("SELECT id FROM ships")


@pytest.fixture
def accounts(db):
    db.execute("CREATE TABLE purse (id INTEGER PRIMARY KEY, n INTEGER)")
    db.execute("INSERT INTO purse VALUES (1, 5), (2, 6)")
    yield db
    db.execute("DROP TABLE purse")


def test_the_first_of_two_writers_wins(accounts):
    e = accounts
    one, two = e.begin(), e.begin()
    one.execute("UPDATE purse SET n = 1 WHERE id = 1")
    assert one.execute("SELECT n FROM purse WHERE id = 1") == [{"n": 1}]
    assert e.execute("SELECT n FROM purse WHERE id = 1") == [{"n": 5}]
    two.execute("UPDATE purse SET n = 2 WHERE id = 1")
    assert one.commit()
    with pytest.raises(RuntimeError):
        two.commit()
    assert e.execute("SELECT n FROM purse WHERE id = 1") == [{"n": 1}]


def test_range_reads_see_phantoms_and_readers_commit(accounts):
    e = accounts
    phantom, reader = e.begin(), e.begin()
    phantom.scan("purse", 0, 10).count()
    phantom.execute("INSERT INTO docks VALUES ('Tjalk', 1)")
    reader.execute("SELECT * FROM purse")
    e.execute("INSERT INTO purse VALUES (5, 1)")
    with pytest.raises(RuntimeError):
        phantom.commit()
    assert reader.commit()


def test_a_write_between_check_and_publication_is_seen(accounts, monkeypatch):
    """The other commit comes after validation, in the midst of ours."""
    from lakeloom.sources.versioned import VersionedTable

    e, plain, done = accounts, VersionedTable.commit, []

    def commit(self, changes, read_version=None):
        if self.name == "purse" and not done:
            done.append(1)
            e.execute(f"INSERT INTO purse VALUES ({done_key[0]}, 100)")
        return plain(self, changes, read_version)

    monkeypatch.setattr(VersionedTable, "commit", commit)
    done_key = [1]  # the row that ours has read: ours must fail
    own = e.begin()
    own.execute("UPDATE purse SET n = n + 1 WHERE id = 1")
    with pytest.raises(RuntimeError):
        own.commit()
    assert values(e, "SELECT id, n FROM purse") == [(1, 100), (2, 6)]
    done.clear()
    done_key[0] = 9  # a row that ours neither reads nor writes: both stay
    blind = e.begin()
    blind.execute("INSERT INTO purse VALUES (2, 7)")
    assert blind.commit()
    assert values(e, "SELECT id, n FROM purse") == [(1, 100), (2, 7), (9, 100)]


def test_compaction_under_an_open_transaction(accounts):
    e = accounts
    e.execute("DELETE FROM purse WHERE id = 2")
    own = e.begin()
    own.execute("UPDATE purse SET n = 8 WHERE id = 1")
    e.table("purse").compact()
    assert own.commit()  # nobody changed what it read
    late = e.begin()
    late.execute("UPDATE purse SET n = 9 WHERE id = 1")
    e.execute("DELETE FROM purse WHERE id = 1")
    e.table("purse").compact()
    with pytest.raises(RuntimeError):  # the deletion is not forgotten, and the row does not come back
        late.commit()
    assert values(e, "SELECT id FROM purse") == []


def test_bound_parameters(db):
    assert db.execute("SELECT id FROM ships WHERE hull = :n", n="Brigg' OR 1=1") == []
    assert db.select("ships", "hull = :n", n="Kogge") == [{"id": 9, "hull": "Kogge", "crew": 30}]
