"""Collector files to a graph: nodes and edges from nested JSON, in one pass over the files.

Every family of edges is a row of ``FAMILIES``: the array (or '' for the entity), a condition, and expressions for both
ends and the type. The files are parsed once (operators/nested.child_rows); families, duplicates, missing ends and derived
edges are DataFrame operations, so no file depends on another's order.
"""

from __future__ import annotations

import codecs
import zlib
from io import BytesIO
from zipfile import BadZipFile, ZipFile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.model import Graph, NodeTable, RelTable
from graphloom.operators import nested
from graphloom.runtime import cut

# Names of file types, of rights and of local groups.
LABELS = {"user": "User", "group": "Group", "computer": "Computer", "domain": "Domain", "gpo": "GPO", "ou": "OU", "container": "Container", "certtemplate": "CertTemplate", "enterpriseca": "EnterpriseCA", "rootca": "RootCA", "aiaca": "AIACA", "ntauthstore": "NTAuthStore"}
RIGHTS = """GenericAll GenericWrite WriteOwner WriteDacl Owns AddMember AddSelf ForceChangePassword AllExtendedRights AddKeyCredentialLink AddAllowedToAct WriteSPN
WriteAccountRestrictions ReadLAPSPassword ReadGMSAPassword SyncLAPSPassword DumpSMSAPassword GetChanges GetChangesAll GetChangesInFilteredSet Enroll ManageCA
ManageCertificates WritePKINameFlag WritePKIEnrollmentFlag HostsCAService DelegatedEnrollmentAgent""".split()
CA_RIGHTS = ["ManageCA", "ManageCertificates", "Enroll"]
LOCAL_GROUP_SUFFIXES = {"-544": "AdminTo", "-555": "CanRDP", "-580": "CanPSRemote", "-562": "ExecuteDCOM"}
LOCAL_GROUP_NAMES = {"ADMINISTRATORS": "AdminTo", "REMOTE DESKTOP": "CanRDP", "REMOTE MANAGEMENT": "CanPSRemote", "DISTRIBUTED COM": "ExecuteDCOM", "REMOTE INTERACTIVE LOGON": "RemoteInteractiveLogonRight"}
SAME_FOREST = ["parentchild", "treeroot", "shortcut"]
IMPLIED_MEMBERS = [("-501", "-S-1-1-0"), ("-513", "-S-1-5-11"), ("-515", "-S-1-5-11"), ("-S-1-5-11", "-S-1-1-0")]
ACCOUNT_FLAGS = {
    "password_not_required": 0x20,
    "password_never_expires": 0x10000,
    "smartcard_required": 0x40000,
    "trusted_for_delegation": 0x80000,
    "not_delegated": 0x100000,
    "dont_require_preauth": 0x400000,
    "password_expired": 0x800000,
    "trusted_to_auth_for_delegation": 0x1000000,
    "account_locked_out": 0x10,
}

MOST_PROPERTIES = 2000

_ENTITY = ["ObjectIdentifier", "Properties.name", "Properties.domainsid", "Properties.unconstraineddelegation", "Properties.useraccountcontrol", "Properties.enabled", "PrimaryGroupSID", "HostingComputer", "DomainSID", "ContainedBy.ObjectIdentifier"]
_OUTER = ["Name", "ObjectIdentifier"]
_MEMBER = ["ObjectIdentifier", "ObjectType"]
_SPEC = {
    "": [],
    "Members": _MEMBER,
    "Sessions": ["UserSID"],
    "Sessions.Results": ["UserSID"],
    "PrivilegedSessions": ["UserSID"],
    "PrivilegedSessions.Results": ["UserSID"],
    "RegistrySessions": ["UserSID"],
    "RegistrySessions.Results": ["UserSID"],
    "LocalGroups.Results": _MEMBER,
    "Aces": ["PrincipalSID", "RightName", "IsInherited"],
    "AllowedToDelegate": _MEMBER,
    "AllowedToAct": _MEMBER,
    "Links": ["GUID", "IsEnforced"],
    "Trusts": ["TargetDomainSid", "TargetDomainName", "TrustDirection", "TrustType"],
    "EnabledCertTemplates": _MEMBER,
    "CARegistryData.CertChain": _MEMBER,
    "CARegistryData.CASecurity.Data": ["PrincipalSID", "RightName", "IsInherited"],
    "NTAuthCertificates": _MEMBER,
}


def collector_rows(files: DataFrame) -> DataFrame:
    """All entities and nested elements the families need; ``label`` from the file's type (singular or plural)."""
    rows = nested.child_rows(files, _SPEC, _ENTITY, _OUTER, properties="Properties")
    names = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    singular = F.regexp_replace("data_type", "s$", "")
    me = F.when(F.col("e0") != "", F.col("e0"))
    return rows.withColumn("me", me).withColumn("label", F.coalesce(names[singular], F.lit("Base"))).where("me is not null")


def entity_nodes(rows: DataFrame) -> DataFrame:
    """id, name, label, domainsid, enabled, account flags and all properties; of several loads the one of the highest file id
    counts. ``properties``: every field of the entity's Properties as text (arrays and objects as JSON), without nulls, empty
    arrays and the names that are columns of every node."""
    control = F.col("e4").try_cast("bigint")
    flags = [(F.when(control.bitwiseAND(F.lit(mask)) != 0, True)).alias(name) for name, mask in ACCOUNT_FLAGS.items()]
    enabled = F.coalesce(F.col("e5").try_cast("boolean"), control.bitwiseAND(F.lit(2)) == 0)
    own = F.map_filter("properties", lambda k, v: v.isNotNull() & (v != "[]") & ~k.isin("objectid", "name", "label"))
    shown = F.when(control.isNotNull(), F.concat(F.lit("0x"), F.hex(control)))
    every = rows.where("array_path = ''").select("file_id", "entity_pos", F.col("me").alias("id"), F.coalesce("e1", "me").alias("name"), "label", F.col("e2").alias("domainsid"), enabled.alias("enabled"), shown.alias("useraccountcontrol_hex"), *flags, own.alias("properties"))
    keep = [c for c in every.columns if c not in ("file_id", "entity_pos", "id")]
    best = F.max_by(F.struct(*keep), F.struct("file_id", "entity_pos")).alias("n")
    return every.groupBy("id").agg(best).select("id", "n.*")


def _edge(source: Column, target: Column, kind: Column | str) -> Column:
    return F.struct(source.cast("string").alias("source"), target.cast("string").alias("target"), (F.lit(kind) if isinstance(kind, str) else kind).alias("rel_type"))


def entity_edges(rows: DataFrame) -> DataFrame:
    """source, target, rel_type, inherited, enforced of all families, each edge once (of repeats the first file's)."""
    me, path, label = F.col("me"), F.col("array_path"), F.col("label")
    f0, f1, f2 = F.col("f0"), F.col("f1"), F.col("f2")
    group = F
    for suffix, kind in LOCAL_GROUP_SUFFIXES.items():
        group = group.when(F.col("o1").endswith(suffix), kind)
    for name, kind in LOCAL_GROUP_NAMES.items():
        group = group.when(F.upper("o0").contains(name), kind)
    direction = F.lower("f2")
    out = direction.isin("2", "3", "outbound", "bidirectional")
    back = direction.isin("1", "3", "inbound", "bidirectional")
    forest = F.when(F.lower("f3").isin(*SAME_FOREST), "SameForestTrust").otherwise("CrossForestTrust")
    here = lambda p, *edges: (path == p, F.array(*edges))
    none = F.lit(None).cast("string")
    domain = label == "Domain"
    alone = [
        _edge(me, F.col("e6"), "MemberOf"),
        _edge(F.col("e9"), me, "Contains"),
        *(_edge(F.when(domain, F.concat(me, F.lit(a))), F.concat(me, F.lit(b)), "MemberOf") for a, b in IMPLIED_MEMBERS),
        _edge(F.when(label == "EnterpriseCA", F.col("e7")), me, "HostsCAService"),
        _edge(me, F.when(label == "EnterpriseCA", F.col("e2")), "EnterpriseCAFor"),
        _edge(me, F.when(label == "RootCA", F.col("e8")), "RootCAFor"),
        _edge(me, F.when(label == "NTAuthStore", F.col("e8")), "NTAuthStoreFor"),
        _edge(me, F.when((label == "Computer") & (F.col("e3") == "true"), F.col("e2")), "CoerceToTGT"),
    ]
    families = [
        here("", *alone),
        here("Members", _edge(f0, me, "MemberOf")),
        (path.rlike("^(Privileged|Registry)?Sessions"), F.array(_edge(me, f0, "HasSession"))),
        here("LocalGroups.Results", _edge(f0, me, group.otherwise(none))),
        here("Aces", _edge(F.when(f0 != me, f0), me, F.when(f1.isin(*RIGHTS), f1))),
        here("AllowedToDelegate", _edge(me, f0, "AllowedToDelegate")),
        here("AllowedToAct", _edge(f0, me, "AllowedToAct")),
        here("Links", _edge(f0, me, "GPLink")),
        here("Trusts", _edge(F.when(out, me), f0, forest), _edge(F.when(back, f0), me, forest)),
        here("EnabledCertTemplates", _edge(F.when(label == "EnterpriseCA", f0), me, "PublishedTo")),
        here("CARegistryData.CertChain", _edge(me, F.when(label == "EnterpriseCA", f0), "IssuedSignedBy")),
        here("CARegistryData.CASecurity.Data", _edge(F.when((label == "EnterpriseCA") & (f0 != me), f0), me, F.when(f1.isin(*CA_RIGHTS), f1))),
        here("NTAuthCertificates", _edge(F.when(label == "NTAuthStore", f0), me, "TrustedForNTAuth")),
    ]
    edges = F
    for condition, made in families:
        edges = edges.when(condition, made)
    inherited = F.when(path.isin("Aces", "CARegistryData.CASecurity.Data"), F.coalesce(f2 == "true", F.lit(False)))
    enforced = F.when(path == "Links", F.coalesce(f1 == "true", F.lit(False)))
    every = rows.select("file_id", inherited.alias("inherited"), enforced.alias("enforced"), F.explode(edges).alias("e")).select("file_id", "inherited", "enforced", "e.*")
    every = every.where("source <> '' and target <> '' and rel_type is not null")
    first = F.min_by(F.struct("inherited", "enforced"), F.col("file_id")).alias("p")
    return every.groupBy("source", "target", "rel_type").agg(first).select("source", "target", "rel_type", "p.*")


def replication_edges(edges: DataFrame) -> DataFrame:
    """DCSync edges: who holds GetChanges and GetChangesAll on one target, directly or as a member of a holding group."""
    held = edges.where(F.col("rel_type").isin("GetChanges", "GetChangesAll")).select("source", "target", "rel_type")
    members = edges.where("rel_type = 'MemberOf'").select(F.col("source").alias("member"), F.col("target").alias("source"))
    wide = held.unionByName(held.join(members, "source").select(F.col("member").alias("source"), "target", "rel_type"))
    both = wide.groupBy("source", "target").agg(F.count_distinct("rel_type").alias("n")).where("n = 2")
    return both.select("source", "target", F.lit("DCSync").alias("rel_type"))


def missing_ends(nodes: DataFrame, edges: DataFrame, known_names: DataFrame | None = None) -> DataFrame:
    """Placeholder nodes (label Base) for ends no file describes."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    lost = ends.join(nodes.select("id"), "id", "left_anti")
    if known_names is not None:
        lost = lost.join(known_names, "id", "left")
        return lost.select("id", F.coalesce("name", "id").alias("name"), F.coalesce("label", F.lit("Base")).alias("label"))
    return lost.select("id", F.col("id").alias("name"), F.lit("Base").alias("label"))


def trust_names(rows: DataFrame) -> DataFrame:
    """Names of domains that are only known from trusts."""
    return rows.where("array_path = 'Trusts' and f0 is not null and f1 is not null").groupBy(F.col("f0").alias("id")).agg(F.min("f1").alias("name"), F.lit("Domain").alias("label"))


def named_by_domain(nodes: DataFrame, domains: DataFrame) -> DataFrame:
    """Nodes get their domain: the longest known domain id that is a prefix of theirs, up to a hyphen. Nodes without a name
    of their own get the domain's name and what follows its id.

    Each id has as many prefixes as hyphens, so this is an equi-join on prefixes, not a range join."""
    parts = F.split("id", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "-"))
    named = domains.where("name is not null").groupBy(F.col("id").alias("prefix")).agg(F.max("name").alias("domain"))
    found = nodes.select("id", F.explode(prefixes).alias("prefix")).join(named, "prefix")
    best = found.groupBy("id").agg(F.max_by(F.struct("domain", "prefix"), F.length("prefix")).alias("d"))
    own = F.col("name").isNull() | (F.col("name") == F.col("id"))
    known = F.col("d.domain").isNotNull() & (F.col("d.domain") != F.col("d.prefix")) & ~F.startswith("d.domain", F.lit("S-1-")) & (F.col("id") != F.col("d.prefix"))
    called = F.concat("d.domain", F.expr("substring(id, length(d.prefix) + 1)"))
    columns = [F.when(own & known, called).otherwise(F.col("name")).alias("name") if c == "name" else F.col(c) for c in nodes.columns]
    return nodes.join(best, "id", "left").select(*columns, F.col("d.domain").alias("domain"))


def with_property_columns(nodes: DataFrame) -> DataFrame:
    """The properties map as columns, named in lower case: boolean, bigint or double where all values are such, else text.

    The names are found in the nodes; more than MOST_PROPERTIES are an error."""
    spread = nodes.select(F.explode("properties").alias("k", "v")).select(F.lower("k").alias("k"), "v")
    low = F.lower("v")
    kinds = (
        spread.groupBy("k").agg(F.bool_and(low.isin("true", "false")).alias("b"), F.bool_and(F.col("v").rlike(r"^-?(0|[1-9]\d{0,17})$")).alias("i"), F.bool_and(F.col("v").rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")).alias("f"))
        .orderBy("k").limit(MOST_PROPERTIES + 1).collect()
    )
    if len(kinds) > MOST_PROPERTIES:
        raise ValueError(f"more than {MOST_PROPERTIES} different properties")
    entries = F.transform(F.map_entries("properties"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1)  # names that differ only in case: the first
    lowered = nodes.withColumn("properties", F.map_from_entries(first))
    columns = []
    for r in kinds:
        if r["k"] not in {c.lower() for c in nodes.columns}:
            v = F.col("properties")[r["k"]]
            columns.append((v.cast("boolean") if r["b"] else v.cast("bigint") if r["i"] else v.cast("double") if r["f"] else v).alias(r["k"]))
    return lowered.select(*(c for c in nodes.columns if c != "properties"), *columns)


def collector_tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (with placeholders and their domains) and edges (with derived ones)."""
    rows = cut(collector_rows(files))
    known, found = entity_nodes(rows), entity_edges(rows)
    edges = found.unionByName(replication_edges(found), allowMissingColumns=True)
    extra = missing_ends(known, edges, trust_names(rows))
    every = known.withColumn("placeholder", F.lit(False)).unionByName(extra.withColumn("placeholder", F.lit(True)), allowMissingColumns=True)
    return named_by_domain(every, every.where("label = 'Domain'")), edges


def collector_graph(spark: SparkSession, files: DataFrame) -> Graph:
    nodes, edges = collector_tables(files)
    nodes = with_property_columns(cut(nodes))
    rels = edges.withColumn("id", F.xxhash64("source", "target", "rel_type"))
    return Graph((NodeTable(nodes.withColumn("labels", F.array("label"))),), (RelTable(rels),))


def _decoded(raw: bytes) -> str:
    """The text of a file: UTF-8, or UTF-16 or UTF-32 with a byte order mark."""
    for mark, encoding in ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if raw.startswith(mark):
            return raw.decode(encoding)
    return raw.decode("utf-8")


def read_collector_files(spark: SparkSession, path: str) -> DataFrame:
    """file_id, file_name, content and error from JSON files and zip archives of them (one row for each file; ids from the
    paths). What can't be read (a broken archive or member, bytes that are no text) is a row with null content and the error."""

    def unpack(batches):
        for batch in batches:
            out = []

            def add(name: str, read) -> None:
                try:
                    out.append((name, _decoded(read()), None))  # noqa: B023
                except (UnicodeDecodeError, BadZipFile, zlib.error, NotImplementedError, RuntimeError, OSError, EOFError) as e:
                    out.append((name, None, f"{type(e).__name__}: {e}"))  # noqa: B023

            for name, raw in zip(batch["path"], batch["content"], strict=True):
                if name.lower().endswith(".zip"):
                    try:
                        archive = ZipFile(BytesIO(raw))
                    except (BadZipFile, OSError, EOFError) as e:
                        out.append((name, None, f"{type(e).__name__}: {e}"))
                        continue
                    for m in archive.namelist():
                        if m.lower().endswith(".json"):
                            add(f"{name}!{m}", lambda m=m, z=archive: z.read(m))
                elif name.lower().endswith(".json"):
                    add(name, lambda raw=raw: raw)
            yield pd.DataFrame(out, columns=["file_name", "content", "error"])

    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return read.select("path", "content").mapInPandas(unpack, "file_name string, content string, error string").withColumn("file_id", F.xxhash64("file_name"))
