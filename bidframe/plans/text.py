"""Queries on names, titles, filing texts, feeds and listings.

Filing texts are written from the orders' columns in several forms, so the oracle knows each answer from the columns and needs no pattern.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bidframe.functions import filings, names
from bidframe.operators import quality
from bidframe.plans.registry import query
from bidframe.plans.standin import table, with_tables
from bidframe.sources import feeds, sinks

#: Whole euros and cents of an order, and the amount as a text in French form.
_EUROS, _CENTS = "CAST(floor(o_totalprice) AS BIGINT) % 900 + 1", "lpad(CAST(o_orderkey % 100 AS VARCHAR(20)), 2, '0')"
_AMOUNT = f"concat(CAST({_EUROS} AS VARCHAR(20)), ',', {_CENTS})"
_PRICE = f"CAST(concat(CAST({_EUROS} AS VARCHAR(20)), '.', {_CENTS}) AS DOUBLE)"

_FR_TEXT = (
    "CASE o_orderkey % 6 "
    f"WHEN 0 THEN concat('Historique : cession au prix de 3,10 € par action. L’initiateur s’engage irrévocablement à acquérir les actions au prix unitaire\nde ', {_AMOUNT}, ' € par action.') "
    f"WHEN 1 THEN concat('le prix libellé initialement au prix de 9,69 € par action était rehaussé au prix de ', {_AMOUNT}, ' € par action') "
    f"WHEN 2 THEN concat('obligations d''une valeur nominale unitaire de 17,00 € chacune ;', repeat(' texte', 16), ' prix de ', {_AMOUNT}, ' € par titre puis 99,00 €') "
    f"WHEN 3 THEN concat('prix offert : ', CAST({_EUROS} AS VARCHAR(20)), ' CHF') WHEN 4 THEN 'aucun montant dans ce document' "
    f"ELSE concat('montant de 1', chr(160), '000 EUR et ', {_AMOUNT}, ' EUR') END"
)


def _spread(rows):
    """Rows dealt over all cores by their key: a table of narrow rows has few row groups, each one task, while the texts made of it take long to search."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "o_orderkey")


def _orders(spark, d, **cols):
    return _spread(table(spark, d, "orders")).select(F.col("o_orderkey").alias("id"), *[F.expr(v).alias(k) for k, v in cols.items()])


@query(
    f"SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 3 THEN CAST({_EUROS} AS DOUBLE) WHEN 4 THEN NULL WHEN 5 THEN 1000 ELSE {_PRICE} END AS amount, CASE o_orderkey % 6 WHEN 3 THEN 'CHF' WHEN 4 THEN NULL ELSE 'EUR' END AS currency, "
    "CASE o_orderkey % 6 WHEN 0 THEN 'engagement_clause' WHEN 1 THEN 'surenchere_raised' WHEN 4 THEN 'no_match' ELSE 'fallback_first_match' END AS source FROM orders"
)
def fr_offer_price(spark, d):
    got = _orders(spark, d, text=_FR_TEXT).withColumn("x", filings.fr_offer_price(F.col("text")))
    return got.select("id", F.col("x.amount").cast("double").alias("amount"), "x.currency", "x.source")


_DE_TEXT = (
    "CASE o_orderkey % 5 "
    f"WHEN 0 THEN concat('anteiliger Betrag am Grundkapital von EUR 1,00. Der Angebotspreis von EUR ', {_AMOUNT}, ' je Aktie') "
    f"WHEN 1 THEN concat('Gegenleistung in Höhe von ', {_AMOUNT}, ' EUR je Aktie') "
    f"WHEN 2 THEN concat('Gewährung einer Gegenleistung von 0,4 Stückaktien A der MFE Media N.V. je einer Aktie sowie Barangebot: EUR ', {_AMOUNT}) "
    f"WHEN 3 THEN 'Nennbetrag EUR 5,00 je Aktie' ELSE concat('Barangebot von Nennwert, Geldleistung: Geldbetrag EUR ', {_AMOUNT}) END"
)


@query(
    f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 IN (2, 3) THEN NULL ELSE {_PRICE} END AS amount, CASE o_orderkey % 5 WHEN 2 THEN 'suspect_mixed' WHEN 3 THEN 'suspect_low_unverified' ELSE 'verified_cash' END AS flag FROM orders"
)
def de_offer_price(spark, d):
    got = _orders(spark, d, text=_DE_TEXT).withColumn("x", filings.de_offer_price(F.col("text")))
    return got.select("id", F.col("x.amount").cast("double").alias("amount"), "x.flag")


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 2 THEN 0.4 END AS share_ratio, CASE WHEN o_orderkey % 5 = 2 THEN {_PRICE} END AS cash_eur, CASE WHEN o_orderkey % 5 = 2 THEN 'MFE Media N.V' END AS acquirer FROM orders")
def de_consideration(spark, d):
    got = _orders(spark, d, text=_DE_TEXT).withColumn("x", filings.de_consideration(F.col("text")))
    return got.select("id", F.col("x.share_ratio").cast("double").alias("share_ratio"), F.col("x.cash_eur").cast("double").alias("cash_eur"), F.col("x.acquirer").alias("acquirer"))


@query(f"SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN {_PRICE} WHEN 1 THEN 2850 ELSE NULL END AS price FROM orders")
def it_offer_price(spark, d):
    text = f"CASE o_orderkey % 3 WHEN 0 THEN concat('un corrispettivo di Euro ', {_AMOUNT}, ' per azione e 7,77 euro') WHEN 1 THEN 'prezzo 28.50 EUR' ELSE 'nessun prezzo' END"
    return _orders(spark, d, text=text).select("id", filings.it_price(F.col("text")).cast("double").alias("price"))


_DAY, _MONTH, _YEAR = "CAST(o_orderkey % 31 + 1 AS VARCHAR(20))", "o_orderkey % 12", "CAST(2000 + o_orderkey % 20 AS VARCHAR(20))"
_FR_NAME = f"CASE {_MONTH} WHEN 0 THEN 'janvier' WHEN 1 THEN 'Février' WHEN 2 THEN 'mars' WHEN 3 THEN 'avril' WHEN 4 THEN 'mai' WHEN 5 THEN 'juin' WHEN 6 THEN 'juillet' WHEN 7 THEN 'AOÛT' WHEN 8 THEN 'septembre' WHEN 9 THEN 'octobre' WHEN 10 THEN 'novembre' ELSE 'decembre' END"
_REAL = f"TRY_CAST(concat({_YEAR}, '-', lpad(CAST({_MONTH} + 1 AS VARCHAR(20)), 2, '0'), '-', lpad({_DAY}, 2, '0')) AS DATE)"


@query(f"SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN coalesce({_REAL}, DATE '2011-02-03') WHEN 1 THEN {_REAL} WHEN 2 THEN {_REAL} ELSE NULL END AS day FROM orders")
def first_date(spark, d):
    text = (
        f"CASE o_orderkey % 4 WHEN 0 THEN concat('Paris, le ', {_DAY}, ' ', {_FR_NAME}, ' ', {_YEAR}, ' (2011-02-03)') WHEN 1 THEN concat('déposé le ', {_YEAR}, '-', CAST({_MONTH} + 1 AS VARCHAR(20)), '-', {_DAY}) "
        f"WHEN 2 THEN concat('le ', {_DAY}, '/', CAST({_MONTH} + 1 AS VARCHAR(20)), '/', {_YEAR}) ELSE 'sans date' END"
    )
    return _orders(spark, d, text=text).select("id", filings.first_date(F.col("text")).alias("day"))


_DE_NAME = f"CASE {_MONTH} WHEN 0 THEN 'Januar' WHEN 1 THEN 'feb' WHEN 2 THEN 'März' WHEN 3 THEN 'April' WHEN 4 THEN 'Mai' WHEN 5 THEN 'Juni' WHEN 6 THEN 'jul' WHEN 7 THEN 'August' WHEN 8 THEN 'Sept' WHEN 9 THEN 'Oktober' WHEN 10 THEN 'nov' ELSE 'Dezember' END"


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 < 2 THEN {_REAL} END AS opens, CASE o_orderkey % 3 WHEN 0 THEN DATE '2026-04-30' WHEN 1 THEN DATE '2026-05-31' END AS closes FROM orders")
def de_acceptance_period(spark, d):
    text = (
        f"CASE o_orderkey % 3 WHEN 0 THEN concat('Die Annahmefrist läuft vom ', {_DAY}, '. ', {_DE_NAME}, ' ', {_YEAR}, ' bis zum 30. April 2026.') "
        f"WHEN 1 THEN concat('Beginn der Annahmefrist: ', {_DAY}, '.', CAST({_MONTH} + 1 AS VARCHAR(20)), '.', {_YEAR}, ' / Ende: 31.05.2026') ELSE 'ohne Frist' END"
    )
    got = _orders(spark, d, text=text).withColumn("x", filings.de_period(F.col("text")))
    return got.select("id", F.col("x.start").alias("opens"), F.col("x.end").alias("closes"))


_IT_NAME = f"CASE {_MONTH} WHEN 0 THEN 'gennaio' WHEN 1 THEN 'febbraio' WHEN 2 THEN 'marzo' WHEN 3 THEN 'aprile' WHEN 4 THEN 'maggio' WHEN 5 THEN 'giugno' WHEN 6 THEN 'luglio' WHEN 7 THEN 'agosto' WHEN 8 THEN 'settembre' WHEN 9 THEN 'ottobre' WHEN 10 THEN 'novembre' ELSE 'dicembre' END"


@query(f"SELECT o_orderkey AS id, concat('Comunicazione n. 0', CAST(o_orderkey AS VARCHAR)) AS visa, {_REAL} AS visa_day, {_REAL} AS opens, CASE WHEN {_REAL} IS NOT NULL THEN DATE '2026-04-30' END AS closes FROM orders")
def it_visa_and_period(spark, d):
    text = f"concat('Comunicazione n. 0', CAST(o_orderkey AS VARCHAR(20)), ' del ', {_DAY}, '/', CAST({_MONTH} + 1 AS VARCHAR(20)), '/', {_YEAR}, '. Adesione dal ', {_DAY}, ' ', {_IT_NAME}, ' ', {_YEAR}, ' al 30 aprile 2026')"
    got = _orders(spark, d, text=text).withColumn("v", filings.it_visa(F.col("text"))).withColumn("p", filings.it_period(F.col("text")))
    return got.select("id", F.col("v.visa").alias("visa"), F.col("v.day").alias("visa_day"), F.col("p.start").alias("opens"), F.col("p.end").alias("closes"))


@query(
    "SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'opa_simplifiee' WHEN 1 THEN 'opa' WHEN 2 THEN 'opa_obligatoire' WHEN 3 THEN 'opr_ro' WHEN 4 THEN 'ope' WHEN 5 THEN 'opra' WHEN 6 THEN 'garantie_de_cours' END AS kind, CASE WHEN o_orderkey % 8 < 7 THEN concat('ALPHA ', o_custkey) END AS target FROM orders"
)
def fr_titles(spark, d):
    title = (
        "concat(CASE o_orderkey % 8 WHEN 0 THEN 'Offre publique d''achat simplifiée' WHEN 1 THEN 'OPA' WHEN 2 THEN 'OPA obligatoire' WHEN 3 THEN 'offre publique de retrait obligatoire' WHEN 4 THEN 'Offre publique d''échange' "
        "WHEN 5 THEN 'Offre publique de rachat' WHEN 6 THEN 'Garantie de cours' ELSE 'Communiqué' END, CASE WHEN o_orderkey % 8 < 7 THEN concat(' visant les actions de la société ALPHA ', CAST(o_custkey AS VARCHAR(20)), '.') ELSE '' END)"
    )
    return _orders(spark, d, t=title).select("id", filings.fr_deal_type(F.col("t")).alias("kind"), filings.title_target(F.col("t")).alias("target"))


@query(
    "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'delisting_offer' WHEN 1 THEN 'opa_obligatoire' WHEN 2 THEN 'opa_volontaire_totalitaria' WHEN 3 THEN 'prohibition_ungenutzt' END AS de_type, "
    "CASE o_orderkey % 5 WHEN 0 THEN 'opas' WHEN 1 THEN 'opa_consolidamento' WHEN 2 THEN 'opa_obligatoire' WHEN 3 THEN 'opa_volontaire_parziale' END AS it_type, CASE o_orderkey % 5 WHEN 0 THEN 'opr_ro' WHEN 1 THEN 'garantie_de_cours' WHEN 2 THEN 'opa' WHEN 3 THEN 'ope' END AS op_type, "
    "CASE o_orderkey % 5 WHEN 0 THEN 'opa_obligatoire' WHEN 1 THEN 'pflichtangebot' WHEN 2 THEN 'opa' WHEN 3 THEN 'ope' END AS canonical, CASE o_orderkey % 5 WHEN 0 THEN 'OPRO' WHEN 1 THEN 'Pflichtangebot' WHEN 2 THEN 'OPA' WHEN 3 THEN 'OPE' END AS legacy FROM orders"
)
def deal_type_rules(spark, d):
    pick = lambda *v: "CASE o_orderkey % 5 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(v)) + " ELSE 'nichts' END"
    rows = _orders(
        spark, d, de=pick("Delisting-Erwerbsangebot", "PFLICHTANGEBOT / Erwerbsangebot", "Freiwilliges ÜBERNAHMEANGEBOT", "Untersagung"), it=pick("offerta di acquisto e scambio", "consolidamento", "OPA obbligatoria", "volontaria  parziale"),
        op=pick("OPRRO", "OPAGC", "PreOffre", "OPES"), old=pick("OPRO", "Pflichtangebot", "OPA", "OPE"),
    )
    canonical = filings.canonical_type(F.col("old"))
    return rows.select("id", filings.de_deal_type(F.col("de")).alias("de_type"), filings.it_deal_type(F.col("it")).alias("it_type"), filings.operation_type(F.col("op")).alias("op_type"), canonical.alias("canonical"), filings.legacy_type(canonical).alias("legacy"))


@query("SELECT o_orderkey AS id, concat('Gamma ', o_custkey, ' AG') AS fr_target, concat('Delta ', o_orderkey) AS fr_acquirer, concat('Gamma ', o_custkey, ' AG') AS de_target, concat('Delta ', o_orderkey, ' GmbH') AS de_bidder, concat('Gamma ', o_custkey) AS it_target, concat('Delta ', o_orderkey, ' S.p.A') AS it_bidder FROM orders")
def labelled_parties(spark, d):
    c, o = "CAST(o_custkey AS VARCHAR(20))", "CAST(o_orderkey AS VARCHAR(20))"
    rows = _orders(
        spark, d, fr=f"concat('Société visée : Gamma ', {c}, ' AG.\n(suite) Initiateur : Delta ', {o}, '\n: fin')", de=f"concat('Bieterin: Delta ', {o}, '  GmbH Zielgesellschaft: Gamma ', {c}, ' AG, ISIN DE000')", it=f"concat('Emittente: Gamma ', {c}, ';\nOfferente: Delta ', {o}, ' S.p.A.; altro')"
    )
    return rows.select(
        "id", filings.fr_target(F.col("fr")).alias("fr_target"), filings.fr_acquirer(F.col("fr")).alias("fr_acquirer"), filings.de_party(F.col("de"), "Zielgesellschaft").alias("de_target"), filings.de_party(F.col("de"), "Bieter(?:in)?").alias("de_bidder"),
        filings.it_party(F.col("it"), r"Societ[àa]\s+oggetto|Emittente|Societ[àa]\s+target").alias("it_target"), filings.it_party(F.col("it"), "Offerente").alias("it_bidder"),
    )


@query(
    f"SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 4 THEN 'suspect_low_unverified' ELSE 'verified_cash' END AS fr_flag, CASE WHEN {_PRICE} < 5 THEN 'below_5' WHEN {_PRICE} > 500 THEN 'above_500' ELSE 'normal' END AS bucket, "
    f"CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN {_PRICE} = 3.1 THEN 1 ELSE 2 END WHEN 1 THEN CASE WHEN {_PRICE} = 9.69 THEN 1 ELSE 2 END WHEN 2 THEN CASE WHEN {_PRICE} IN (17, 99) THEN 2 ELSE 3 END ELSE 0 END AS n_amounts FROM orders"
)
def flags_and_buckets(spark, d):
    rows = _orders(spark, d, text=_FR_TEXT, price=_PRICE)
    amounts = F.size(filings.all_amounts(F.col("text")))
    return rows.select("id", filings.fr_quality_flag(filings.fr_offer_price(F.col("text"))["amount"]).alias("fr_flag"), filings.outlier_bucket(F.col("price")).alias("bucket"), amounts.alias("n_amounts"))


#: Texts with a match's first character and the one after its last.
_AROUND = "trim(regexp_replace(replace(text, chr(160), ' ')[greatest(s - {before}, 1):e + {after} - 1], '\\s+', ' ', 'g'))"
_REVIEWED = f"t AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, {_AMOUNT} AS a, {_PRICE} AS p, {_FR_TEXT} AS text FROM orders)"
_CLAUSE_SPAN = "CASE k WHEN 0 THEN instr(text, 's’engage') WHEN 1 THEN instr(text, 'rehaussé au prix') + 9 WHEN 2 THEN instr(text, ' prix de ') + 1 END AS s, CASE k WHEN 0 THEN instr(text, 'unitaire\nde ') + 12 WHEN 1 THEN instr(text, 'rehaussé au prix de ') + 20 WHEN 2 THEN instr(text, ' prix de ') + 9 END + len(a) + 2 AS e"


@query(
    f"WITH {_REVIEWED}, m AS (SELECT id, text, true AS principal, 1 AS n, p AS amount, {_CLAUSE_SPAN} FROM t WHERE k = 0 UNION ALL SELECT id, text, false, 1, CASE k WHEN 0 THEN 3.1 WHEN 1 THEN 9.69 ELSE 17 END, b, b + CASE k WHEN 2 THEN 7 ELSE 6 END FROM (SELECT *, instr(text, CASE k WHEN 0 THEN '3,10 €' WHEN 1 THEN '9,69 €' ELSE '17,00 €' END) AS b FROM t WHERE k < 3) "
    "UNION ALL SELECT id, text, false, 2, p, b, b + len(a) + 2 FROM (SELECT *, CASE k WHEN 1 THEN instr(text, 'rehaussé au prix de ') + 20 ELSE instr(text, ' prix de ') + 9 END AS b FROM t WHERE k IN (1, 2)) UNION ALL SELECT id, text, false, 3, 99, instr(text, 'puis ') + 5, instr(text, 'puis ') + 12 FROM t WHERE k = 2), "
    "u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id, amount ORDER BY principal DESC, n) = 1) "
    f"SELECT id, principal, row_number() OVER (PARTITION BY id ORDER BY principal DESC, n) - 1 AS pos, CAST(amount AS DOUBLE) AS amount, {_AROUND.format(before=150, after=150)} AS context FROM u"
)
def amount_candidates(spark, d):
    """All amounts that a review has to weigh, the bidder's own clauses first, with the text around them."""
    got = _orders(spark, d, text=_FR_TEXT).withColumn("x", filings.amount_candidates(F.col("text")))
    marked = lambda part, own: F.transform(f"x.{part}", lambda v: F.struct(F.lit(own).alias("principal"), v["amount"].cast("double").alias("amount"), v["context"].alias("context")))
    rows = got.select("id", F.posexplode(F.concat(marked("principal", True), marked("other", False))).alias("pos", "v"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), "v.principal", "v.amount", "v.context")


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'HIGH' WHEN o_orderkey % 6 = 1 AND {_PRICE} = 9.69 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 6 = 1 AND {_PRICE} = 9.69 THEN {_PRICE} END AS guess FROM orders")
def best_guess(spark, d):
    got = _orders(spark, d, text=_FR_TEXT).withColumn("x", filings.best_guess(F.col("text")))
    return got.select("id", "x.confidence", F.col("x.price").cast("double").alias("guess"))


@query(
    f"WITH {_REVIEWED}, c AS (SELECT id, k, p, text, {_CLAUSE_SPAN} FROM t), v AS (SELECT *, CASE WHEN k > 2 THEN 'NO_CLAUSE' WHEN id % 5 = 0 THEN 'MISSING' WHEN k = 0 OR p = 7 THEN 'MATCH' ELSE 'MISMATCH' END AS verdict FROM c) "
    "SELECT id, CASE WHEN k < 3 THEN p END AS clause_price, verdict, CASE WHEN k > 2 THEN 'no_engagement_clause' WHEN k = 0 THEN concat('single_engagement_clause', CASE WHEN verdict <> 'MISSING' THEN concat('_', lower(verdict)) ELSE '' END) WHEN verdict = 'MISSING' THEN 'fallback_only' ELSE concat(lower(verdict), '_via_fallback') END AS status, "
    f"CASE WHEN k < 3 THEN {_AROUND.format(before=80, after=120)} END AS excerpt FROM v"
)
def clause_verdict(spark, d):
    stored = f"CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN CAST({_EUROS} + (o_orderkey % 100) / 100.0 AS DECIMAL(18,6)) ELSE CAST(7 AS DECIMAL(18,6)) END"
    got = _orders(spark, d, text=_FR_TEXT, stored=stored).withColumn("x", filings.clause_verdict(F.col("text"), F.col("stored")))
    return got.select("id", F.col("x.price").cast("double").alias("clause_price"), "x.verdict", "x.status", "x.excerpt")


_NO_TEXT = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {} END"
_FR_TITLE = "CASE o_orderkey % 3 WHEN 0 THEN concat('OFFRE PUBLIQUE DE RETRAIT visant les actions de la société Gamma ', CAST(o_orderkey AS VARCHAR(20)), '.') WHEN 1 THEN 'Dépôt' END"
_FR_FILING = _NO_TEXT.format(f"concat('Offre publique d''achat simplifiée. Société visée : Beta ', CAST(o_custkey AS VARCHAR(20)), '\nInitiateur : Delta ', CAST(o_orderkey AS VARCHAR(20)), '\nParis, le 3 mars 2024. prix offert : ', {_AMOUNT}, ' €', repeat(' suite', 200))")
_DE_FILING = _NO_TEXT.format(
    f"concat('Bieterin: Delta ', CAST(o_orderkey AS VARCHAR(20)), ' GmbH Zielgesellschaft: Gamma ', CAST(o_custkey AS VARCHAR(20)), ' AG, ISIN DE0\nPflichtangebot. ', CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE concat('Angebotspreis: EUR ', {_AMOUNT}, ' je Aktie. ') END, 'Annahmefrist vom 1. März 2024 bis 30. April 2026', repeat(' weiter', 200))"
)
_IT_FILING = _NO_TEXT.format(
    f"concat('Comunicazione n. 0', CAST(o_orderkey AS VARCHAR(20)), ' del 5 marzo 2024. Emittente: Gamma ', CAST(o_custkey AS VARCHAR(20)), ';\nOfferente: Delta ', CAST(o_orderkey AS VARCHAR(20)), ' S.p.A.; dal 1 aprile 2024 al 30 aprile 2026. ', CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE concat('Corrispettivo: Euro ', {_AMOUNT}) END, repeat(' segue', 200))"
)


def _records(rows, record, country):
    """A country's records, flat, with prices as doubles, and whether each says enough to be stored."""
    got = rows.withColumn("r", record).withColumn("enough", filings.has_minimum(F.col("r"), country))
    return got.select("id", "r.*", "enough").withColumn("offer_price", F.col("offer_price").cast("double"))


@query(
    f"WITH t AS (SELECT o_orderkey AS id, o_custkey AS c, {_FR_FILING} AS text, {_PRICE} AS p FROM orders), r AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'opr' WHEN text IS NOT NULL THEN 'opa_simplifiee' END AS deal_type FROM t) "
    "SELECT id, deal_type, CASE WHEN id % 3 = 0 THEN concat('Gamma ', id) WHEN text IS NOT NULL THEN concat('Beta ', c) END AS target_name, CASE WHEN text IS NOT NULL THEN concat('Delta ', id) END AS acquirer_name, CASE WHEN text IS NOT NULL THEN DATE '2024-03-03' END AS announcement_date, "
    "CASE WHEN text IS NOT NULL THEN p END AS offer_price, CASE WHEN text IS NOT NULL THEN 'EUR' END AS currency, CASE WHEN text IS NOT NULL THEN 'fallback_first_match' ELSE 'no_match' END AS source, text[1:1024] AS sample, deal_type IS NOT NULL AS enough FROM r"
)
def fr_filing_records(spark, d):
    return _records(_orders(spark, d, title=_FR_TITLE, text=_FR_FILING), filings.fr_filing(F.col("title"), F.col("text")), "FR")


@query(
    f"WITH t AS (SELECT o_orderkey AS id, o_custkey AS c, {_DE_FILING} AS text, {_PRICE} AS p FROM orders), r AS (SELECT *, CASE WHEN id % 3 <> 1 AND text IS NOT NULL THEN p END AS offer_price FROM t) "
    "SELECT id, CASE WHEN text IS NOT NULL THEN DATE '2024-03-01' END AS opening_date, CASE WHEN text IS NOT NULL THEN DATE '2026-04-30' END AS closing_date, offer_price, CASE WHEN offer_price IS NOT NULL THEN 'EUR' END AS currency, CASE WHEN offer_price IS NOT NULL THEN 'verified_cash' ELSE 'suspect_low_unverified' END AS flag, "
    "CASE WHEN text IS NOT NULL THEN concat('Gamma ', c, ' AG') END AS target_name, CASE WHEN text IS NOT NULL THEN concat('Delta ', id, ' GmbH') END AS acquirer_name, CASE WHEN text IS NOT NULL THEN 'Pflichtangebot' END AS offer_type, text[1:1024] AS sample, text IS NOT NULL AS enough FROM r"
)
def de_filing_records(spark, d):
    return _records(_orders(spark, d, text=_DE_FILING), filings.de_filing(F.col("text")), "DE")


@query(
    f"WITH t AS (SELECT o_orderkey AS id, o_custkey AS c, {_IT_FILING} AS text, {_PRICE} AS p FROM orders), r AS (SELECT *, CASE WHEN id % 3 <> 1 AND text IS NOT NULL THEN p END AS offer_price FROM t) "
    "SELECT id, CASE WHEN text IS NOT NULL THEN concat('Comunicazione n. 0', id) END AS visa, CASE WHEN text IS NOT NULL THEN DATE '2024-03-05' END AS announcement_date, CASE WHEN text IS NOT NULL THEN DATE '2024-04-01' END AS opening_date, CASE WHEN text IS NOT NULL THEN DATE '2026-04-30' END AS closing_date, offer_price, "
    "CASE WHEN offer_price IS NOT NULL THEN 'EUR' END AS currency, CASE WHEN text IS NOT NULL THEN concat('Gamma ', c) END AS target_name, CASE WHEN text IS NOT NULL THEN concat('Delta ', id, ' S.p.A') END AS acquirer_name, text[1:1024] AS sample, text IS NOT NULL AS enough FROM r"
)
def it_filing_records(spark, d):
    return _records(_orders(spark, d, text=_IT_FILING), filings.it_filing(F.col("text")), "IT")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'conformity_decision' WHEN 1 THEN 'deposit_notice' WHEN 2 THEN 'deposit_notice_byheader' WHEN 3 THEN 'procedural_other' ELSE 'other' END AS kind, CASE o_orderkey % 5 WHEN 0 THEN 'OCEANE' WHEN 1 THEN 'SURENCHERE' WHEN 2 THEN 'BLOCK_PURCHASE' ELSE 'NO_CLAUSE' END AS dominant FROM orders")
def document_types(spark, d):
    text = "CASE o_orderkey % 5 WHEN 0 THEN 'Décision de conformité. OCÉANE au lieu de' WHEN 1 THEN 'Dépôt d’un projet d’offre ; prix relevé' WHEN 2 THEN '218C2043-FR0010492193-OP123-AS01 hors marché' WHEN 3 THEN 'Calendrier' ELSE 'rien' END"
    rows = _orders(spark, d, text=text)
    return rows.select("id", filings.document_type(F.col("text")).alias("kind"), filings.price_traps(F.col("text"))["dominant"].alias("dominant"))


@query(
    with_tables("deals") + "SELECT id, isin, concat('BAFIN-', isin, '-', strftime(announcement_date, '%Y%m%d')) AS ref, isin AS of_key, isin AS cleaned, isin AS found FROM deals"
)
def isin_extract(spark, d):
    rows = table(spark, d, "deals")
    ref = names.filing_key(F.col("isin"), F.col("announcement_date"), F.lit("https://x.example/a/b.html"))
    spaced = F.concat(F.substring("isin", 1, 4), F.lit(" "), F.lower(F.substring("isin", 5, 8)))
    return rows.select("id", F.when(names.is_isin(F.col("isin")), F.col("isin")).alias("isin"), ref.alias("ref"), names.isin_of_key(ref).alias("of_key"), names.clean_isin(spaced).alias("cleaned"), names.first_isin(F.lit(None).cast("string"), F.lit("none here"), F.concat(F.lit("code "), "isin", F.lit("."))).alias("found"))


@query(
    with_tables("deals") + "SELECT id, upper(CASE WHEN target_name = '[pending parse]' THEN 'PENDING PARSE' ELSE target_name END) || ' HOLDING' AS norm, CASE WHEN target_name = '[pending parse]' THEN 'pending-parse' ELSE lower(replace(target_name, ' ', '-')) END AS slug, target_name AS trimmed, target_name AS trimmed_offer, CASE WHEN id % 3 = 0 THEN substring(target_name, 1, 6) ELSE '[pending parse]' END AS safe FROM deals"
)
def name_normalise(spark, d):
    t = F.col("target_name")
    return table(spark, d, "deals").select("id", names.normalise_name(F.concat(t, F.lit(" Holding AG  S.p.A. SE"))).alias("norm"), names.slug(t).alias("slug"), names.trim_company_name(F.concat(t, F.lit("  (vertreten durch X), z. Hd. Y"))).alias("trimmed"), names.trim_offer_name(F.concat(t, F.lit("  ai sensi dell'art. 102; avente"))).alias("trimmed_offer"), names.safe_name(F.when(F.col("id") % 3 == 0, t).when(F.col("id") % 3 == 1, "  "), 6).alias("safe"))


@query(
    with_tables("deals") + "SELECT acquirer_name, CASE WHEN lower(acquirer_name) LIKE '%qatar%' THEN 'soe' WHEN lower(acquirer_name) LIKE '%holding%' THEN 'pe' WHEN lower(acquirer_name) LIKE '%gmbh' THEN 'corporate' WHEN lower(acquirer_name) LIKE '%group%' THEN 'unknown' ELSE 'family' END AS class, count(*) AS n FROM deals GROUP BY 1, 2"
)
def acquirer_class(spark, d):
    return table(spark, d, "deals").groupBy("acquirer_name", names.acquirer_class(F.col("acquirer_name")).alias("class")).agg(F.count("*").alias("n"))


@query(with_tables("deals") + "SELECT id, CASE WHEN contains(acquirer_name, 'Maison') THEN 'MAI.PA' WHEN contains(acquirer_name, 'Qatar') THEN 'QAT.QA' END AS acquirer_ticker FROM deals")
def acquirer_registry(spark, d):
    registry = spark.createDataFrame([("maison", 0, "MAI.PA", "FR0000000001"), ("qatar fund", 1, "QAT.QA", "QA0000000002"), ("qatar", 2, "NO.QA", "QA0000000003")], "part string, pos int, ticker string, isin string")
    return names.registry_match(table(spark, d, "deals"), registry).select("id", "acquirer_ticker")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'ALCLA.PA' WHEN 1 THEN 'MND1.DE' WHEN 2 THEN 'EUR.MI' END AS ticker, CASE o_orderkey % 4 WHEN 0 THEN 'ALCLA' WHEN 1 THEN 'MND1' WHEN 2 THEN 'EUR' END AS symbol FROM orders")
def venue_tickers(spark, d):
    rows = _orders(spark, d, t="CASE o_orderkey % 4 WHEN 0 THEN 'ALCLAEUR' WHEN 1 THEN 'MND1EUR' WHEN 2 THEN 'EUR' ELSE 'ZZ' END", v="CASE o_orderkey % 4 WHEN 0 THEN 'XS' WHEN 1 THEN 'GY' WHEN 2 THEN 'IM' ELSE 'QQ' END")
    ticker = names.venue_ticker(F.col("t"), F.col("v"))
    return rows.select("id", ticker.alias("ticker"), names.broker_symbol(ticker).alias("symbol"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def filing_text_assembly(spark, d):
    """The given documents, each line a page."""
    pages = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page_no", "text"))
    return feeds.filing_text(pages, 3, ("doc_id",))


_FEED = (
    "concat('{\"id\":', CAST(o_orderkey AS STRING), ',\"numero\":\" N', CAST(o_custkey AS STRING), ' \",\"typesOperation\":[\"', CASE o_orderkey % 3 WHEN 0 THEN 'OPA' WHEN 1 THEN 'OPRRO' ELSE 'X' END, '\"],', "
    "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '\"dateInformation\":null,' END, '\"datePublication\":\"', date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:00:00.1234567+00:00\",\"societes\":[{\"raisonSociale\":\" Cible ', CAST(o_custkey AS STRING), '\",\"role\":\"', "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'SocieteVisee' ELSE 'SocieteConcernee' END, '\"}', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ',{\"raisonSociale\":\"Init\",\"role\":\"Initiateur\"}' END, '],\"documents\":[{\"nomFichier\":\"a\"},{\"path\":\"/x.pdf\",\"accessible\":false},{\"path\":\"/d/', CAST(o_orderkey AS STRING), '.pdf\",\"accessible\":true}]}')"
)


@query(
    "SELECT o_orderkey AS id, concat('N', o_custkey) AS numero, concat('Cible ', o_custkey) AS target_name, CASE WHEN o_orderkey % 5 <> 0 THEN 'Init' END AS acquirer_name, CASE o_orderkey % 3 WHEN 0 THEN 'opa' WHEN 1 THEN 'opr_ro' END AS deal_type, CAST(o_orderdate AS DATE) AS announcement_date, concat('/d/', o_orderkey, '.pdf') AS pdf_path FROM orders"
)
def feed_scan(spark, d):
    return feeds.item_terms(feeds.feed_items(_spread(table(spark, d, "orders")).select(F.expr(_FEED).alias("value")))).drop("operation")


@query("SELECT o_orderkey AS id, CAST((row_number() OVER (ORDER BY o_orderkey DESC) - 1) // 50 AS INT) AS page FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey DESC) <= 120")
def feed_page_slice(spark, d):
    return feeds.page_slice(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), [F.desc("id")], 50, 120)


@query(
    "SELECT o_orderkey AS id, concat('Ziel ', o_custkey) AS target_name, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('DE', lpad(CAST(o_custkey AS VARCHAR), 10, '0')) END AS target_isin, 'opa_obligatoire' AS deal_type, CAST(o_orderdate AS DATE) AS published, o_orderkey % 2 = 0 AS is_amendment, "
    "concat('BAFIN-', CASE WHEN o_orderkey % 3 = 0 THEN concat('seite', o_orderkey) ELSE concat('DE', lpad(CAST(o_custkey AS VARCHAR), 10, '0')) END, '-', strftime(o_orderdate, '%Y%m%d')) AS regulator_ref FROM orders WHERE o_orderkey % 7 <> 0"
)
def de_listing_scan(spark, d):
    html = (
        "concat('<table class=\"data\"><tr><th>Bieter</th></tr><tr><td>nur</td><td>vier</td></tr><tr><td>Bieter &amp; Co</td><td> Ziel ', CAST(o_custkey AS STRING), ', vertreten</td><td>', CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE concat('DE', substring(lpad(CAST(o_custkey AS STRING), 10, '0'), 1, 3), ' ', substring(lpad(CAST(o_custkey AS STRING), 10, '0'), 4, 7)) END, "
        "'</td><td><a class=\"l\" href=\"/x/seite', CAST(o_orderkey AS STRING), '.html?nn=1\">Pflichtangebot', CASE WHEN o_orderkey % 2 = 0 THEN ' Änderung' ELSE '' END, '</a></td><td>', CASE WHEN o_orderkey % 7 = 0 THEN '31.02.2020' ELSE date_format(o_orderdate, 'dd.MM.yyyy') END, '</td></tr></table>')"
    )
    pages = _spread(table(spark, d, "orders")).select(F.col("o_orderkey").cast("string").alias("url"), F.expr(html).alias("html"))
    return feeds.de_listing(pages).select(F.col("url").cast("bigint").alias("id"), "target_name", "target_isin", "deal_type", "published", "is_amendment", "regulator_ref")


@query(
    "SELECT o_orderkey AS id, concat('Offerente ', o_orderkey) AS bidder_name, concat('Bersaglio ', o_custkey) AS target_name, 'opa_volontaire_totalitaria' AS deal_type, CAST(o_orderdate AS DATE) AS period_start, DATE '2026-01-31' AS period_end, CASE WHEN o_orderkey % 3 > 0 THEN concat('/doc/d', o_orderkey, '.pdf') END AS document_url, "
    "CASE WHEN o_orderkey % 3 > 0 THEN concat('CONSOB-d', o_orderkey) ELSE concat('CONSOB-bersaglio-', o_custkey, '-offerente-', o_orderkey, '-', strftime(o_orderdate, '%Y%m%d')) END AS regulator_ref, 1 AS n_links FROM orders"
)
def it_listing_scan(spark, d):
    html = (
        "concat('<ul class=\"consobResult\"><li class=\"header\"><div>x</div></li><li><div class=\"div20\">', date_format(o_orderdate, 'dd/MM/yyyy'), ' - 31/01/2026</div><div class=\"div80\"><p>Opa volontaria totalitaria di <strong>Offerente ', CAST(o_orderkey AS STRING), ', Milano</strong> su <strong>Bersaglio ', CAST(o_custkey AS STRING), "
        "'</strong></p><span class=\"pdf\">', CASE WHEN o_orderkey % 3 > 0 THEN concat('<a href=\"/doc/d', CAST(o_orderkey AS STRING), '.pdf\">Documento d''offerta</a>') ELSE '' END, '<a href=\"/c.pdf\">Comunicato</a></span></div></li></ul>')"
    )
    pages = _spread(table(spark, d, "orders")).select(F.col("o_orderkey").cast("string").alias("url"), F.expr(html).alias("html"))
    return feeds.it_listing(pages).select(F.col("url").cast("bigint").alias("id"), "bidder_name", "target_name", "deal_type", "period_start", "period_end", "document_url", "regulator_ref", F.size("other_links").alias("n_links"))


@query("SELECT o_orderkey AS id, concat('AMF-2024-C-', lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')) AS regulator_ref, CAST(date_trunc('day', o_orderdate) + INTERVAL 9 HOUR AS TIMESTAMP) AS published_at FROM orders WHERE o_orderkey % 3 < 2")
def bid_news(spark, d):
    rows = _spread(table(spark, d, "orders")).selectExpr(
        "o_orderkey AS id", "CASE o_orderkey % 3 WHEN 0 THEN 'Une opa est ouverte' WHEN 1 THEN 'Note' ELSE 'Comptes annuels' END AS title", "concat('https://x.example/AMF-2024-C-', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')) AS link",
        "CASE WHEN o_orderkey % 3 = 1 THEN 'Garantie de cours' END AS summary", "concat(date_format(o_orderdate, 'EEE, dd MMM yyyy'), ' 10:00:00 +0100') AS published",
    )
    return feeds.bid_news(rows).select("id", "regulator_ref", "published_at")


_LINK = r'<a href="/([^"])([^"]*)">([^<]*)</a>'


@query("SELECT url, " + ", ".join(f"nullif(regexp_extract(html, '{_LINK}', {k}), '') AS {n}" for k, n in enumerate(("year", "reference", "hash"), 1)) + f" FROM pages WHERE regexp_extract(html, '{_LINK}', 1) <> ''")
def document_links(spark, d):
    """The first link of each given page, in three parts."""
    return feeds.document_links(table(spark, d, "pages"), _LINK)


@query(
    with_tables("deals") + "SELECT id, concat('{\"kind\":\"', deal_type, '\"', CASE WHEN offer_price IS NOT NULL THEN concat(',\"has_price\":true') ELSE '' END, '}') AS payload, concat(deal_type, ': ', CASE WHEN acquirer_name = '[pending parse]' THEN '?' ELSE acquirer_name END, ' -> ', CASE WHEN target_name = '[pending parse]' THEN '?' ELSE target_name END) AS line FROM deals"
)
def event_payloads(spark, d):
    payload = sinks.to_payload(kind=F.col("deal_type"), has_price=F.when(F.col("offer_price").isNotNull(), True), gap=sinks.clean_number(F.lit(float("nan"))))
    return table(spark, d, "deals").select("id", payload.alias("payload"), sinks.describe_filing(F.col("deal_type"), F.col("target_name"), F.col("acquirer_name")).alias("line"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN concat('/a/b', o_orderkey, '.pdf?__blob=publicationFile&v=1') ELSE '/a/b.pdf' END AS document FROM orders")
def document_urls(spark, d):
    return _orders(spark, d, u="CASE WHEN o_orderkey % 2 = 0 THEN concat('/a/b', CAST(o_orderkey AS STRING), '.html?nn=12') ELSE '/a/b.pdf' END").select("id", filings.listing_document(F.col("u")).alias("document"))


@query(
    f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 IN (3, 4) THEN 'unchanged_silent' WHEN o_orderkey % 6 = 5 THEN 'lost' WHEN o_orderkey % 6 < 2 AND {_AMOUNT} = CASE o_orderkey % 6 WHEN 0 THEN '3,10' ELSE '9,69' END THEN 'unchanged_extracted' ELSE 'changed_extracted' END AS impact FROM orders"
)
def pattern_impact(spark, d):
    """The first amount in euros, by sign or code, against the last one by sign."""
    return _orders(spark, d, text=_FR_TEXT).select("id", quality.pattern_impact(F.col("text"), r"(\d[\d,]*) (?:€|EUR)", r"(?s).*[^\d,](\d[\d,]*) €").alias("impact"))
