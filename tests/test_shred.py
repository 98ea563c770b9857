import json

from hemicycle.operators import shred
from hemicycle.plans.integrity import PROPOSAL_LINKS, PROPOSAL_ROLES, PROPOSAL_SCALARS, SESSION_LINKS, SESSION_ROLES, SESSION_SCALARS


def found(spark, payloads, roles=PROPOSAL_ROLES, scalars=PROPOSAL_SCALARS, links=PROPOSAL_LINKS, key_of={"proposingParty": "acronym"}):  # noqa: B006
    rows = spark.createDataFrame([(i, p, 1, "x") for i, p in enumerate(payloads)], "record_id long, payload string, node int, label string")
    nodes = shred.shred(rows, "record_id", "payload", frozenset(x for x in roles if x))
    return {tuple(r) for r in shred.links(shred.entity_tables(nodes, roles, scalars, key_of, "test"), links).collect()}


BLOCK = {"id": 7, "politicalPartyAcronym": "ABC", "votingOrientation": "InFavor"}
SIMPLE = {("votingResultGenerality", "5", "proposal", "1"), ("votingBlock", "7", "votingResultGenerality", "5")}


def proposal(blocks, **more):
    return {"id": 1, "votingResultGenerality": {"id": "5", "votingBlocks": blocks}, **more}


def test_every_wrapping_gives_the_same_links(spark):
    shapes = [
        proposal([BLOCK]),
        [proposal([BLOCK])],
        {"data": proposal([BLOCK]), "meta": {"page": 1, "flags": []}},
        {"data": {"proposals": [proposal([BLOCK])]}},
        proposal({"$id": "3", "$values": [BLOCK]}),
        proposal({"7": {k: v for k, v in BLOCK.items() if k != "id"}}),
        proposal(BLOCK),
        proposal(json.dumps([BLOCK])),
        proposal([None, BLOCK]),
        {"Id": "001", "VotingResultGenerality": {"Id": 5, "VotingBlocks": [{"Id": 7.0}]}},
        {"id": 1, "voting_result_generality": {"id": 5, "voting_blocks": [{"id": " 7 "}]}},
    ]
    for shape in shapes:
        assert found(spark, [json.dumps(shape)]) == SIMPLE, shape
    assert found(spark, [json.dumps(json.dumps(shapes[0]))]) == SIMPLE
    assert found(spark, ["﻿  \n" + json.dumps(shapes[0]), json.dumps(shapes[0])]) == SIMPLE


def test_what_is_broken_null_or_without_key(spark):
    whole = json.dumps(proposal([BLOCK], proposingParty="XYZ"))
    assert found(spark, [whole]) == SIMPLE | {("proposingParty", "XYZ", "proposal", "1")}
    assert found(spark, [whole[:-3], None, "", "null", "3", "[]", "{}", whole + "]", "[" * 5000]) == set()
    assert found(spark, [json.dumps({"id": 1, "proposingParty": None, "votingResultGenerality": {}, "votingResultSpeciality": None})]) == set()
    assert found(spark, [json.dumps({"votingResultGenerality": {"id": 5}, "proposingParty": {"partyAcronym": "", "fullName": None}})]) == set()
    assert found(spark, []) == set()


def test_depth_has_no_limit(spark):
    deep = lambda inner, n: '{"x": [' * n + inner + "]}" * n
    block = json.dumps(proposal([BLOCK]))
    for n in (10, 20_000, 60_000):
        assert found(spark, [deep(json.dumps({"data": proposal([BLOCK])}), n)]) == SIMPLE
        assert found(spark, ['{"y": ' + "[" * n + "]" * n + ", " + block[1:]]) == SIMPLE
        assert found(spark, [deep(block, n)[:-1], deep(block, n) + "}", "[" * n]) == set()


def test_deep_parser_agrees():
    good = ['{"a": [1, 2.5, -3e2, true, false, null, "x\\"y\\u00e9"], "b": {}, "c": [], "d": [[], [{}]]}', " 3 ", '"s"', "[]", '{"a": {"a": 1}, "a": 2}', '["\\n{[,:]}"]']
    for text in good:
        assert shred._parsed_deep(text) == json.loads(text)
    for text in ["", "[", "]", "[1,]", "[,1]", "{,}", '{"a"}', '{"a":}', '{"a" 1}', "[1 2]", "{1: 2}", '["a]', "[1]]", "1 2", "nul", '{"a": 1,}', "[}", '"a', "[1}", ":", '{"a": 1 "b": 2}']:
        for parse in (shred._parsed_deep, json.loads):
            try:
                parse(text)
            except ValueError:
                continue
            raise AssertionError(text)


def test_the_join_gives_the_same_entities(spark, data_dir):
    for name, roles, scalars in (("proposal", PROPOSAL_ROLES, PROPOSAL_SCALARS), ("session", SESSION_ROLES, SESSION_SCALARS)):
        nodes = shred.shred(spark.read.parquet(f"{data_dir}/{name}_records.parquet"), "record_id", "payload", frozenset(x for x in roles if x))
        grouped = shred.entities(nodes, roles, scalars)
        joined = shred.joined_entities(nodes, roles, scalars).select(*grouped.columns)
        assert grouped.count() > 100 and sorted(map(str, grouped.collect())) == sorted(map(str, joined.collect()))


def test_only_wanted_scalars(spark):
    rows = spark.createDataFrame([(1, json.dumps(proposal([BLOCK])))], "record_id long, payload string")
    every = {tuple(r) for r in shred.shred(rows, "record_id", "payload", frozenset({"votingblocks"})).collect()}
    some = {tuple(r) for r in shred.shred(rows, "record_id", "payload", frozenset({"votingblocks"}), ["id"]).collect()}
    assert some == {r for r in every if r[6] or r[4] == "id"} and len(some) < len(every)


def test_sessions(spark):
    user = {"id": 3, "votes": [{"id": 11, "userID": None}, {"id": None}], "partyStats": {"21": {"politicalParty": {"partyAcronym": "ÁGU"}}, "22": {"politicalParty": "KAI"}, "23": {"politicalParty": None}}}
    links = found(spark, [json.dumps({"users": [user]})], SESSION_ROLES, SESSION_SCALARS, SESSION_LINKS, {"politicalParty": "acronym"})
    assert links == {("vote", "11", "user", "3"), *(("partyStat", k, "user", "3") for k in ("21", "22", "23")), ("politicalParty", "ÁGU", "partyStat", "21"), ("politicalParty", "KAI", "partyStat", "22")}


def test_tables_keep_scalars_and_order(spark):
    rows = spark.createDataFrame([(1, json.dumps(proposal([BLOCK, {"id": 8, "numberOfDeputies": "20"}]))), (1, json.dumps(proposal([BLOCK])))], "record_id long, payload string")
    nodes = shred.shred(rows, "record_id", "payload", frozenset(x for x in PROPOSAL_ROLES if x))
    table = shred.entity_tables(nodes, PROPOSAL_ROLES, PROPOSAL_SCALARS, {}, "test")
    blocks = table.where("role = 'votingBlock'").collect()
    assert sorted((b.key, b.ordinal, b.block_acronym, b.n_deputies) for b in blocks) == [("7", 0, "ABC", None), ("7", 0, "ABC", None), ("8", 1, None, "20")]


def walked(value, roles, key_of, links):
    """Links by plain recursion over the values: (child role, key, parent role, key)."""
    out = set()

    def opened(v):
        if isinstance(v, str) and v.lstrip("\ufeff \n\t")[:1] in ("[", "{"):
            v = json.loads(v.lstrip("\ufeff \n\t"))
        return v

    def key(role, v, map_key):
        named = {k.lower().replace("_", ""): x for k, x in v.items()} if isinstance(v, dict) else {}
        if role in key_of:
            word = named.get("partyacronym") if isinstance(v, dict) else v
            return (str(word).strip() or None) if word is not None else None
        number = (named["id"] if named.get("id") is not None else map_key) if isinstance(v, dict) else v
        return str(int(float(number))) if number is not None and str(number).strip().lstrip("+").replace(".0", "").isdigit() else None

    def visit(v, label, parent, map_key=None):
        v = opened(v) if label in roles else v
        if isinstance(v, list):
            for x in v:
                visit(x, label, parent)
        elif isinstance(v, dict) and "$values" in v:
            visit(v["$values"], label, parent)
        elif isinstance(v, dict) and v and label in roles and label and all(k.isdigit() and isinstance(x, dict) for k, x in v.items()):
            for k, x in v.items():
                visit(x, label, parent, k)
        else:
            role = roles.get(label) if isinstance(v, dict) or v is not None else None
            own = (role, key(role, v, map_key)) if role else None
            if own and parent and own[1] and parent[1] and (own[0], parent[0]) in links:
                out.add((*own, *parent))
            if isinstance(v, dict):
                for k, x in v.items():
                    visit(x, k.lower().replace("_", ""), own)

    visit(value, "", None)
    return out


def test_brute_force_on_stored_records(spark, data_dir):
    from hemicycle.plans.integrity import p5_found

    expected = set()
    for name, roles, key_of, links in (("proposal", PROPOSAL_ROLES, {"proposingParty"}, PROPOSAL_LINKS), ("session", SESSION_ROLES, {"politicalParty"}, SESSION_LINKS)):
        for r in spark.read.parquet(f"{data_dir}/{name}_records.parquet").collect():
            try:
                value = json.loads(r.payload.lstrip("\ufeff \n\t"))
                value = json.loads(value) if isinstance(value, str) else value
            except ValueError:
                continue
            expected |= walked(value, roles, key_of, set(links))
    got = {tuple(r) for r in p5_found(spark, data_dir).collect()}
    assert got == expected and len(got) > 300
