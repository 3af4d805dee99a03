"""Queries on infrastructure files. Each customer has one file, made of a fixed template."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.operators import match
from siltworks.plans import rules
from siltworks.registry import lit, query, table
from siltworks.sources import files as scans

#: Name and content of the files, by turns.
FILES = (
    ("Dockerfile", "FROM node:latest\nENV API_KEY=x\nRUN apt-get install curl\nEXPOSE 22\nUSER root"),
    ("Dockerfile", "FROM alpine:3\nADD http://x/y /y\nCOPY . .\nHEALTHCHECK NONE\nUSER rootless"),
    ("Dockerfile.dev", "# base\nFROM alpine:3\nUSER\nRUN x --privileged"),
    ("docker-compose.yml", "services:\n  a:\n    privileged: true\n    network_mode: host\n    pid: host\n    read_only: false\n    volumes:\n      - /var/run/docker.sock:/x"),
    ("deploy.yml", "version: 3\nservices:\n  b:\n    cap_add:\n      - ALL"),
    ("main.tf", 'encrypted = false\nacl = "public-read"\npassword = "hunter2"\npublicly_accessible = true\nlogging {}'),
    ("net.TF", 'cidr_blocks = ["0.0.0.0/0"]\nskip_final_snapshot = true\nversioning { enabled = false }\nenable_key_rotation = false'),
    ("pod.yaml", "apiVersion: v1\nkind: Pod\nspec:\n  hostNetwork: true\n  hostPID: true\n  containers:\n  - securityContext:\n      privileged: true\n      runAsUser: 0"),
    ("secret.yaml", "kind: Secret\nmetadata:\n  name: x\nstringData:\n  a: b\n---\nspec:\n  readOnlyRootFilesystem: false\n  automountServiceAccountToken: true"),
    ("limits.yaml", "kind: Pod\nresources:\n  limits:\n    cpu: 1\n---\nresources:\n  limits:\n    memory: 1Gi\ncapabilities:\n  add:\n  - SYS_ADMIN"),
    ("stack.yaml", "AWSTemplateFormatVersion: 2010\nResources:\n  X:\n    PubliclyAccessible: true\n    StorageEncrypted: false\n    CidrIp: 0.0.0.0/0"),
    ("stack.json", '{"Resources": {"A": "{{resolve:ssm-secure:x}}",\n"AccessControl": 1,\nAccessControl: PublicRead}}'),
    ("chart/templates/d.yaml", "image: {{ .Values.image }}\nhostIPC: true\nallowPrivilegeEscalation: true"),
    ("readme.txt", "USER root\nprivileged: true"),
)
_AT = f"c_custkey % {len(FILES)}"
_FILES_SQL = f"SELECT c_custkey || '/' || CASE {_AT} " + " ".join(f"WHEN {i} THEN {lit(n)}" for i, (n, _) in enumerate(FILES)) + f" END AS path, CASE {_AT} " + " ".join(f"WHEN {i} THEN {lit(c)}" for i, (_, c) in enumerate(FILES)) + " END AS content FROM customer"


def files(spark, sf):
    of = lambda part: F.element_at(F.array(*(F.lit(f[part]) for f in FILES)), (F.col("c_custkey") % len(FILES) + 1).cast("int"))
    return table(spark, sf, "customer").select(F.concat_ws("/", F.col("c_custkey").cast("string"), of(0)).alias("path"), of(1).alias("content"))


_K8S = r"apiVersion:\s*(?:v1|apps/v1|networking\.k8s\.io|batch/v1)|kind:\s*(?:Pod|Deployment|Service|ConfigMap|Secret|Ingress)"
_NAME = "string_split(lower(path), '/')[-1]"
_YAML = f"regexp_matches({_NAME}, '\\.ya?ml$')"
_TYPED = (
    f"SELECT *, CASE WHEN starts_with({_NAME}, 'dockerfile') THEN 'dockerfile' WHEN starts_with({_NAME}, 'docker-compose') OR starts_with({_NAME}, 'compose') THEN 'docker-compose' WHEN ends_with({_NAME}, '.tf') THEN 'terraform' "
    f"WHEN {_YAML} AND regexp_matches(content, {lit(_K8S)}, 'i') THEN 'kubernetes' WHEN {_YAML} AND regexp_matches(content, 'AWSTemplateFormatVersion|Resources:', 'i') THEN 'cloudformation' "
    f"WHEN {_YAML} AND contains(lower(path), '/templates/') AND regexp_matches(content, '\\{{\\{{.*\\}}\\}}') THEN 'helm' WHEN {_YAML} AND regexp_matches(content, '(?m)^services:') THEN 'docker-compose' "
    f"WHEN ends_with({_NAME}, '.json') AND regexp_matches(content, 'AWSTemplateFormatVersion|Resources', 'i') THEN 'cloudformation' END AS type FROM ({_FILES_SQL})"
)


@query(f"SELECT path, type FROM ({_TYPED})")
def infra_types(spark, sf):
    return files(spark, sf).select("path", match.file_type(F.col("path"), F.col("content")).alias("type"))


@query(" UNION ALL ".join(f"(SELECT path, type FROM ({_TYPED}) WHERE type = '{k}' ORDER BY path LIMIT 20)" for k in ("dockerfile", "docker-compose", "kubernetes", "terraform")))
def infra_files(spark, sf):
    """At most twenty files of each kind, in the order of their paths."""
    parts = [scans.infra(files(spark, sf), k, 20) for k in ("dockerfile", "docker-compose", "kubernetes", "terraform")]
    return reduce(DataFrame.unionByName, parts).select("path", "type")


_LINES = f"SELECT path, type, content, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS line, string_split(content, chr(10)) AS l FROM ({_TYPED})"
#: The manifest pattern with a look-ahead, said otherwise: the line after the limits does not name a processor.
_AHEAD = r"resources:\s*\n\s*limits:\s*\n([^\n]*)"


def _hit(r, col):
    regex = r.patterns[0].regex
    if regex.endswith(")") and "(?!" in regex and "limits" not in regex:
        before, _, ahead = regex[:-1].partition("(?!")
        return f"(regexp_matches({col}, {lit(before)}) AND NOT regexp_matches({col}, {lit(before + ahead)}))"
    if "(?!" in regex:
        return f"len(list_filter(regexp_extract_all({col}, {lit(_AHEAD)}, 1, 'i'), lambda x: NOT contains(lower(x), 'cpu'))) > 0"
    return f"regexp_matches({col}, {lit(regex)})"


_LINE_SQL = " UNION ALL ".join(f"SELECT path, '{r.id}' AS rule_id, {lit(r.name)} AS name, '{r.severity}' AS severity, line FROM lines WHERE type = '{kind}' AND {_hit(r, 't')}" for kind, some in rules.LINE_RULES.items() for r in some)
_NEAR = "array_to_string(l[greatest(1, line - 5):line + 4], chr(10))"
_MANIFEST = "CASE " + " ".join(f"WHEN {_hit(r, 'rest')} AND ({_hit(r, 't')} OR line > 1 AND {_hit(r, 'near')}) THEN {i}" for i, r in enumerate(rules.KUBERNETES)) + " END"
_PICKED = "[" + ", ".join(f"{{'id': '{r.id}', 'name': {lit(r.name)}, 'severity': '{r.severity}'}}" for r in rules.KUBERNETES) + "]"


@query(
    f"WITH lines AS ({_LINES}) {_LINE_SQL} UNION ALL SELECT path, 'IAC-D11', 'No non-root USER specified', 'high', coalesce(first_from, 1) FROM (SELECT path, content, min(line) FILTER (regexp_matches(t, '^FROM\\s', 'i')) AS first_from FROM lines WHERE type = 'dockerfile' GROUP BY path, content) "
    "WHERE NOT regexp_matches(content, '(?im)^USER\\s+\\S+') OR regexp_matches(content, '(?im)^USER\\s+root\\s*$') "
    f"UNION ALL SELECT path, replace(r.id, 'kubernetes', CASE type WHEN 'helm' THEN 'helm' ELSE 'kubernetes' END), r.name, r.severity, line FROM (SELECT *, {_PICKED}[1 + {_MANIFEST}] AS r FROM (SELECT *, array_to_string(l[line:], chr(10)) AS rest, {_NEAR} AS near FROM lines WHERE type IN ('kubernetes', 'helm'))) WHERE r IS NOT NULL"
)
def infra_findings(spark, sf):
    return match.infra_scan(files(spark, sf), rules.LINE_RULES, rules.KUBERNETES)
