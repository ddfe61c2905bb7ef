"""One query for each operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import (decontamination, divergence, fingerprints, line_duplicates, merkle,
                          near_duplicates, packing, personal_data, secrets, substrings, token_files,
                          toxicity, transcripts)
from newsloom.session import configure, scratch_path

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = lambda spark, folder: build(configure(spark), folder)
        if sql is not None:
            _ORACLES[name] = sql
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_packing")
def _(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"),
                                  vocabulary("word_bpe_49k.json"), with_ids=False)


@query("op3_token_files")
def _(spark, folder):
    files = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), files,
                                  vocabulary("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, files, with_ids=False)


@query("op2_fingerprints")
def _(spark, folder):
    return fingerprints.compare_edited(table(spark, folder, "documents"))


@query("op5_jaccard_join")
def _(spark, folder):
    return near_duplicates.near_duplicates(table(spark, folder, "documents")).drop("copy")


@query("op6_transcripts")
def _(spark, folder):
    made = transcripts.as_transcripts(table(spark, folder, "conversations"))
    return transcripts.parse(made, transcripts.fit(made), with_text=False)


@query("op9_line_duplicates")
def _(spark, folder):
    return line_duplicates.line_report(table(spark, folder, "documents"))


@query("op7_personal_data")
def _(spark, folder):
    return personal_data.find_personal_data(table(spark, folder, "documents"))


@query("op8_toxicity")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


FOLDED = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


@query("op4_decontamination", f"""WITH d AS MATERIALIZED (
    SELECT doc_id, {FOLDED} AS w FROM documents),
  b AS (SELECT item_id::VARCHAR AS item, {FOLDED} AS w FROM benchmark),
  bw AS MATERIALIZED (SELECT DISTINCT item, least(10, len(w)) AS n,
    array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
    FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
  sizes AS (SELECT DISTINCT n FROM bw),
  dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
    FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
  hits AS MATERIALIZED (SELECT doc_id, i, dw.n, item FROM dw JOIN bw USING (n, gram)),
  words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def _(spark, folder):
    return decontamination.digest(decontamination.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query("op10_substrings", r"""WITH d AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
  g AS MATERIALIZED (SELECT doc_id, i, hash(array_to_string(w[i:i + 19], ' ')) AS h,
      array_to_string(w[i:i + 19], ' ') AS gram
    FROM d, unnest(range(1, len(w) - 18)) AS u(i) WHERE len(w) >= 20),
  late AS (SELECT doc_id, i FROM g QUALIFY
    row_number() OVER (PARTITION BY h, gram ORDER BY doc_id, i) > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
  lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
  kept AS (SELECT doc_id, string_agg(w[i], ' ' ORDER BY i) AS kept
    FROM d, unnest(range(1, len(w) + 1)) AS u(i)
    WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = d.doc_id AND gone.p = i)
    GROUP BY doc_id)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
  FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def _(spark, folder):
    return substrings.remove_repeats(table(spark, folder, "documents"), with_text=False)


@query("op11_secrets")
def _(spark, folder):
    return secrets.find_secrets(table(spark, folder, "documents"))


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


# The CRC-32 of the decimal id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, bit:
      CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"""


@query("op12_merkle_manifest", f"""WITH RECURSIVE rows_of AS MATERIALIZED (
    SELECT doc_id, coalesce('=' || lang, '') AS grp, {_leaf('n_chars')} AS leaf,
      CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS changed
    FROM documents),
  placed AS MATERIALIZED (SELECT *, row_number() OVER () AS r, row_number() OVER (
      PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
      count(*) OVER (PARTITION BY grp) AS n FROM rows_of),
  tree AS (SELECT grp, 0 AS level, pos, leaf AS h, n FROM placed
    UNION ALL SELECT grp, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
    FROM tree WHERE n > 1 GROUP BY grp, level, pos // 2, n),
  subroots AS MATERIALIZED (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos,
      count(*) OVER () AS n FROM tree WHERE n = 1),
  tops AS (SELECT 0 AS level, pos, h, n FROM subroots
    UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
    FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
  walk AS (SELECT r, grp, 0 AS level, pos, n, changed AS h, '' AS others FROM placed
    UNION ALL SELECT w.r, w.grp, w.level + 1, w.pos // 2, (w.n + 1) // 2, sha256(
      CASE WHEN w.pos % 2 = 0 THEN w.h || coalesce(s.h, '') ELSE s.h || w.h END),
      w.others || coalesce(s.h, '')
    FROM walk w LEFT JOIN tree s ON s.grp = w.grp AND s.level = w.level AND s.pos = xor(w.pos, 1)
    WHERE w.n > 1),
  climb AS (SELECT w.r, 0 AS level, s.pos, s.n, w.h, w.others
    FROM walk w JOIN subroots s ON s.grp = w.grp WHERE w.n = 1
    UNION ALL SELECT w.r, w.level + 1, w.pos // 2, (w.n + 1) // 2, sha256(
      CASE WHEN w.pos % 2 = 0 THEN w.h || coalesce(s.h, '') ELSE s.h || w.h END),
      w.others || coalesce(s.h, '')
    FROM climb w LEFT JOIN tops s ON s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1),
  top AS (SELECT h FROM tops WHERE n = 1)
  SELECT doc_id, leaf, s.h AS subroot, top.h AS root, sha256(c.others) AS proof_sha256,
    c.h AS folded_root, c.h = top.h AS verified
  FROM placed p JOIN subroots s USING (grp) JOIN climb c ON c.r = p.r AND c.n = 1, top""")
def _(spark, folder):
    return merkle.verify_rows(table(spark, folder, "documents"))


LETTERS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
           r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')")


def _share(n: str, total: str) -> str:
    return f"(1 + (1000000000::HUGEINT * ({n} + 1)) // ({total} + v))"


@query("op13_divergence", f"""WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      {LETTERS} AS w FROM documents),
  words AS (SELECT r, lang, source, unnest(w) AS term FROM d),
  kept AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS m FROM words
    GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
  counts AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS n
    FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
  langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(m)::HUGEINT AS total FROM kept GROUP BY lang),
  sums AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY lang, source),
  groups AS MATERIALIZED (SELECT DISTINCT lang, source, coalesce(v, 0) AS v,
      coalesce(sums.total, 0) AS total, coalesce(langs.total, 0) AS lang_total
    FROM d LEFT JOIN langs USING (lang) LEFT JOIN sums USING (lang, source)),
  dense AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n,
      {_share("coalesce(n, 0)", "total")} AS p, {_share("m", "lang_total")} AS q
    FROM groups g JOIN kept USING (lang)
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
  pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL),
  every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM dense
    WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (
    PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
  SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked
  WHERE part = 'pair' OR rank <= 200""")
def _(spark, folder):
    return divergence.audit(table(spark, folder, "documents"))
