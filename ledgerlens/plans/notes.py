"""What is known of a schema's columns: a document of annotations, flattened into rows that a lookup joins.

The document maps tables to columns to attributes. Names that begin with two
underscores hold facts about the schema itself. Every literal that a column is
known to hold becomes a row of its own, with the form that it is matched by, so
resolving a value is a lookup: an exact form first, then a normalised one, then
a marker of missing values.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

META = "__schema_metadata__"
# How a literal relates to what is known of its column.
EXACT, NORMALISED, MARKER, UNOBSERVED, UNMAPPED, NO_MAP, WITHHELD = (
    "exact_match", "normalised_match", "missing_marker", "unobserved_literal", "unmapped_literal", "no_value_map", "withheld_due_to_ambiguous_column",
)
#: Attributes that lookups carry as columns; all others stay in the document.
ATTRIBUTES = ("semantic_role", "measure_type", "unit", "financial_element", "domain_object", "financial_role", "posting_side", "status_dimension", "entity_scope")
EMPTY = (None, "", [], {}, "none")


def plain(value: Any) -> str:
    """A name or literal for matching: no quotes around it, lower case."""
    return unquoted(value).lower()


def unquoted(value: Any) -> str:
    return "" if value is None else str(value).strip().strip("'").strip('"')


@dataclass(frozen=True)
class Literal:
    """What a column's literal stands for."""

    status: str
    concept: str | None = None
    facts: dict = field(default_factory=dict, hash=False)
    warning: str | None = None

    def classes(self) -> list[str]:
        """Accounting classes that the literal speaks of."""
        found = [self.concept, *(self.facts.get(k) for k in ("financial_element", "domain_object", "financial_statement"))]
        return sorted({plain(x) for x in found if plain(x)})


@dataclass
class Note:
    """One annotated column."""

    table: str
    column: str
    attributes: dict
    exact: dict[str, Literal]
    loose: dict[str, Literal]
    default: Literal
    missing: Literal | None

    def get(self, key: str) -> Any:
        return self.attributes.get(key)

    @property
    def place(self) -> str:
        return f"{self.table}.{self.column}"

    def resolve(self, value: Any) -> Literal:
        if value is None and self.missing and "" not in self.exact:
            return self.missing
        found = self.exact.get(unquoted(value)) or self.loose.get(plain(value))
        if found:
            return found
        if self.default.status == UNOBSERVED:
            return Literal(UNOBSERVED, warning=f"{unquoted(value)!r} is no value observed in {self.place}")
        return self.default


def _note(table: str, column: str, attributes: dict) -> Note:
    concepts = attributes.get("value_concepts") or {}
    concepts = concepts if isinstance(concepts, dict) else {}
    details = attributes.get("concept_metadata") or {}
    about = lambda c: details.get(str(c)) if isinstance(details.get(str(c)), dict) else {}
    policy = attributes.get("missing_value_policy") or {}
    missing, loose = None, {}
    if isinstance(policy, dict):
        missing = Literal(MARKER, str(policy.get("meaning", "missing")), warning=_marker_warning(policy))
        loose = {plain(m): missing for m in policy.get("missing_markers") or []}
    careful = attributes.get("literal_match_policy") == "case_sensitive_exact_match_preferred"
    for key, concept in concepts.items():
        warning = f"{key!r} is matched after normalisation only" if careful else None
        loose[plain(key)] = Literal(NORMALISED, str(concept), about(concept), warning)
    exact = {str(k): Literal(EXACT, str(c), about(c)) for k, c in concepts.items()}
    status = NO_MAP if not concepts else UNOBSERVED if attributes.get("invalid_value_policy") == "unobserved_literal_warning" else UNMAPPED
    return Note(table, column, attributes, exact, loose, Literal(status), missing)


def _marker_warning(policy: dict) -> str | None:
    if policy.get("do_not_map_directly_to"):
        return f"a missing marker means {policy.get('meaning', 'missing')}, not {policy['do_not_map_directly_to']}"
    return "a missing marker is no number" if policy.get("do_not_use_for_numeric_computation") else None


class Notes:
    """The document, indexed by column name."""

    def __init__(self, document: dict):
        if not isinstance(document, dict):
            raise ValueError("annotations must be a JSON object")
        self.document = document
        #: What readers of queries worked out by these notes, by its kind and the text; its users bound it.
        self.remembered: dict[tuple, str] = {}
        self.meta: dict = document.get(META) or {}
        self.by_column: dict[str, list[Note]] = {}
        self.tables: dict[str, str] = {}
        for table, columns in document.items():
            if table.startswith("__") or not isinstance(columns, dict):
                continue
            self.tables[table.strip().lower()] = table
            for column, attributes in columns.items():
                self.by_column.setdefault(column.strip().lower(), []).append(_note(table, column, attributes))

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> "Notes":
        """Reads a JSON document, through Spark where a session is given (so from any store)."""
        if spark is None:
            with open(path, encoding="utf-8") as f:
                return cls(json.load(f))
        return cls(json.loads(spark.read.text(path, wholetext=True).first().value))

    def find(self, column: str | None, table: str | None = None, among: list[str] | None = None) -> list[Note]:
        """Notes of a column: of a named table the one, else of all tables of the query (of all, if it names none) that have it."""
        found = self.by_column.get((column or "").strip().lower(), [])
        if table:
            return [n for n in found if n.table.lower() == table.strip().lower()][:1]
        wanted = [t.strip().lower() for t in among or []]
        if not wanted:
            return list(found)
        return sorted((n for n in found if n.table.lower() in wanted), key=lambda n: wanted.index(n.table.lower()))

    def numbers(self) -> set[str]:
        """Whole numbers that an annotation gives a meaning."""
        return {k for own in self.by_column.values() for n in own for k in (*n.exact, *n.loose) if k.isdigit()}

    def table_facts(self, table: str | None) -> dict:
        """Grain, keys and rules of a table."""
        name = self.tables.get((table or "").strip().lower())
        found = (self.meta.get("table_metadata") or {}).get(name) if name else None
        return found if isinstance(found, dict) else {}

    def rules(self) -> dict:
        found = self.meta.get("bookkeeping_rules")
        return found if isinstance(found, dict) else {}

    def posting_effect(self, element: str | None, side: str | None) -> dict:
        """What a posting on a side does to an element of the accounts, if the rules say so."""
        rule = (self.rules().get("posting_effect_rules") or {}).get(plain(element)) if element and side else None
        effect = rule.get(f"{plain(side)}_effect") if isinstance(rule, dict) else None
        return {"financial_element": plain(element), "posting_side": plain(side), "posting_effect": effect, "normal_balance": rule.get("normal_balance")} if effect else {}

    def rebuilds_balances(self) -> bool:
        """Whether the ledger's history allows a balance to be summed up from postings."""
        return bool(self.meta.get("full_history_balance_reconstruction_supported") and self.meta.get("as_of_balance_reconstruction_supported"))

    # as tables
    def rows(self, spark: SparkSession) -> DataFrame:
        """One row for each annotated column."""
        fields = ", ".join(f"{a} string" for a in ATTRIBUTES)
        rows = [(n.table, n.column, *(_text(n.get(a)) for a in ATTRIBUTES), n.default.status, n.missing.concept if n.missing else None) for own in self.by_column.values() for n in own]
        return spark.createDataFrame(rows, f"table string, column string, {fields}, default_status string, missing_concept string")

    def literals(self, spark: SparkSession) -> DataFrame:
        """One row for each literal of a column and way to match it; the lowest rank that matches holds."""
        rows = []
        for n in (n for own in self.by_column.values() for n in own):
            rows += [(n.table, n.column, "clean", form, 0, x.status, x.concept, x.classes()) for form, x in n.exact.items()]
            rows += [(n.table, n.column, "plain", form, 1 if x.status == NORMALISED else 2, x.status, x.concept, x.classes()) for form, x in n.loose.items()]
        return spark.createDataFrame(rows, "table string, column string, way string, form string, rank int, status string, concept string, classes array<string>")


def _text(value: Any) -> str | None:
    return None if value in EMPTY else plain(value)


#: Rows of annotations up to which a lookup is broadcast.
SMALL = 50_000


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def clean_literal(value: Column) -> Column:
    """A literal without the quotes around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), "^'+|'+$", ""), '^"+|"+$', "")


def look_up_columns(refs: DataFrame, notes: Notes) -> DataFrame:
    """References (table or null, column, candidates or null) with the notes of every column that they may mean.

    Adds: note_table, note_column, the attributes, resolution (qualified,
    unique_unqualified, ambiguous_unqualified or unresolved) and candidate_count.
    A reference without a table means the column in all candidate tables, or in
    all tables if there are none; more than one is ambiguous.
    """
    spark = refs.sparkSession
    own = notes.rows(spark).drop("default_status", "missing_concept")
    struct = F.struct(F.col("table").alias("note_table"), F.col("column").alias("note_column"), *ATTRIBUTES)
    index = own.groupBy(F.lower(F.trim("column")).alias("_c")).agg(F.sort_array(F.collect_list(struct)).alias("_notes"))
    count = sum(map(len, notes.by_column.values()))
    asked = refs.join(_sized(index, count), F.lower(F.trim(refs["column"])) == index["_c"], "left").drop("_c")
    table, among = F.lower(F.trim("table")), F.transform(F.col("candidates"), lambda t: F.lower(F.trim(t)))
    fits = lambda n: F.when(table.isNotNull() & (table != ""), F.lower(n["note_table"]) == table).when(F.coalesce(F.size("candidates"), F.lit(0)) > 0, F.array_contains(among, F.lower(n["note_table"]))).otherwise(True)
    asked = asked.withColumn("_notes", F.filter(F.coalesce("_notes", F.array()), fits)).withColumn("candidate_count", F.size("_notes"))
    qualified = table.isNotNull() & (table != "")
    how = F.when(F.col("candidate_count") == 0, "unresolved").when(qualified, "qualified").when(F.col("candidate_count") > 1, "ambiguous_unqualified").otherwise("unique_unqualified")
    return asked.withColumn("resolution", how).withColumn("_n", F.explode_outer("_notes")).select(*refs.columns, "_n.*", "resolution", "candidate_count")


def resolve_values(values: DataFrame, notes: Notes) -> DataFrame:
    """Literals (table, column, value) with status, concept and classes: the best-ranked form that matches holds."""
    spark = values.sparkSession
    literals = notes.literals(spark).select(F.lower("table").alias("_t"), F.lower("column").alias("_c"), F.struct("rank", "status", "concept", "classes", "way", "form").alias("_l"))
    by_column = literals.groupBy("_t", "_c").agg(F.collect_list("_l").alias("_l"))
    count = sum(len(n.exact) + len(n.loose) + 1 for own in notes.by_column.values() for n in own)
    defaults = notes.rows(spark).select(F.lower("table").alias("_t"), F.lower("column").alias("_c"), "default_status", "missing_concept")
    known = defaults.join(by_column, ["_t", "_c"], "left")
    joined = values.join(_sized(known, count), (F.lower(F.trim(values["table"])) == known["_t"]) & (F.lower(F.trim(values["column"])) == known["_c"]), "left")
    clean = clean_literal(F.col("value"))
    hits = F.filter("_l", lambda x: F.when(x["way"] == "clean", x["form"] == clean).otherwise(x["form"] == F.lower(clean)))
    best = F.get(F.sort_array(hits), 0)
    joined = joined.withColumn("_best", best)
    missing = F.col("value").isNull() & F.col("missing_concept").isNotNull()
    return joined.select(
        *values.columns,
        F.coalesce(F.col("_best.status"), F.when(missing, MARKER), "default_status", F.lit(NO_MAP)).alias("status"),
        F.coalesce(F.col("_best.concept"), F.when(missing, F.col("missing_concept"))).alias("concept"),
        F.coalesce(F.col("_best.classes"), F.array().cast("array<string>")).alias("classes"),
    )


def intent_guide(notes: Notes) -> dict:
    """What a reader of questions should know of the schema: parties, measures, dates, classifiers, everyday names and warnings."""
    every = [n for own in notes.by_column.values() for n in own]
    order = {t: k for k, t in enumerate(notes.document)}
    columns = {t: {c: k for k, c in enumerate(v)} for t, v in notes.document.items() if isinstance(v, dict)}
    every.sort(key=lambda n: (order[n.table], columns[n.table][n.column]))
    pick = lambda n, *keys: {k: n.get(k) for k in keys}
    role = lambda n: n.get("semantic_role") or ""
    # Roles and kinds of measure that make a column a measure or a date.
    measures = {"financial_measure", "quantity_measure", "rate_measure", "transaction_group_identifier"}
    dates = {"transaction_date", "system_created_date", "due_date", "entity_date"}
    parties: dict[str, list] = {}
    for n in every:
        if n.get("entity_scope"):
            parties.setdefault(n.get("entity_scope"), []).append({"column": n.place, **pick(n, "semantic_role", "domain_object")})
    return {
        "table_metadata": notes.meta.get("table_metadata", {}),
        "bookkeeping_rules": notes.meta.get("bookkeeping_rules", {}),
        "business_glossary": notes.meta.get("business_glossary", []),
        "entity_roles": parties,
        "measure_concepts": {
            n.place: pick(n, "semantic_role", "measure_type", "unit", "domain_object", "financial_element", "sign_convention", "posting_side", "time_behavior", "requires_account_context", "warning")
            for n in every if role(n) in measures or n.get("measure_type") in ("flow", "stock", "quantity", "rate")
        },
        "date_concepts": {n.place: {**pick(n, "semantic_role", "time_behavior"), "use_for": n.get("use_for") or [], "not_for": n.get("not_for") or []} for n in every if n.get("measure_type") == "date" or role(n) in dates},
        "classifier_concepts": {n.place: {**pick(n, "semantic_role", "entity_scope"), "value_concepts": n.get("value_concepts") or {}, "concept_metadata": n.get("concept_metadata") or {}} for n in every if "classifier" in role(n)},
        "question_aliases": {n.place: n.get("question_aliases") for n in every if isinstance(n.get("question_aliases"), dict) and n.get("question_aliases")},
        "warnings": [{"column": n.place, "warning": n.get("warning")} for n in every if n.get("warning")],
    }


def guide_text(guide: dict, names: bool = True) -> str:
    """The guide for a prompt; without ``names``, only the glossary and the everyday names, no column is shown."""
    lines = ["Glossary:"]
    for term in guide["business_glossary"]:
        lines.append(f"- {term.get('concept')}: {term.get('description')}" + (f" (not {term['distinct_from']})" if term.get("distinct_from") else ""))
    if names:
        lines += ["", "Parties:", *(f"- {party}: {', '.join(sorted({c['column'] for c in own}))}" for party, own in sorted(guide["entity_roles"].items()))]
        lines += ["", "Measures:"]
        for place, own in sorted(guide["measure_concepts"].items()):
            said = [f"{label}={own[k]}" for label, k in (("role", "semantic_role"), ("type", "measure_type"), ("unit", "unit"), ("side", "posting_side"), ("sign", "sign_convention"), ("warning", "warning")) if own.get(k)]
            lines.append(f"- {place}: " + "; ".join(said + (["needs an account"] if own.get("requires_account_context") else [])))
        lines += ["", "Dates:", *(f"- {place}: {own['semantic_role']}; use for {own['use_for']}; not for {own['not_for']}" for place, own in sorted(guide["date_concepts"].items()))]
    lines += ["", "Everyday names:"]
    for place, own in sorted(guide["question_aliases"].items()):
        told = "; ".join(f"{k} means {v}" for k, v in own.items())
        lines.append(f"- {place}: {told}" if names else f"- {told}")
    if names:
        lines += ["", "Warnings:", *(f"- {w['column']}: {w['warning']}" for w in guide["warnings"])]
    return "\n".join(lines)


# The ledger that ships with the engine


def _money(kind: str = "flow", **more) -> dict:
    return {"semantic_role": "financial_measure", "measure_type": kind, "unit": "money", **more}


def _party(scope: str, role: str = "entity_identifier", **more) -> dict:
    return {"semantic_role": role, "entity_scope": scope, **more}


_PAID = {"missing_markers": ["--"], "meaning": "no settlement recorded", "do_not_map_directly_to": "unpaid"}
#: Annotations of the ledger's seven tables.
LEDGER = {
    META: {
        "table_metadata": {
            "master_txn_table": {"table_grain": "posting_line", "transaction_group_key": "Transaction_ID", "balancing_rule": "debits equal credits in each transaction", "count_star_warning": "rows are posting lines, not transactions"},
            "customers": {"table_grain": "customer"},
            "vendors": {"table_grain": "vendor"},
            "employees": {"table_grain": "employee"},
            "products": {"table_grain": "product_service"},
            "chart_of_accounts": {"table_grain": "account"},
            "payment_method": {"table_grain": "payment_method"},
        },
        "bookkeeping_rules": {
            "posting_effect_rules": {
                **{e: {"debit_effect": "increase", "credit_effect": "decrease", "normal_balance": "debit"} for e in ("asset", "expense")},
                **{e: {"debit_effect": "decrease", "credit_effect": "increase", "normal_balance": "credit"} for e in ("liability", "income", "equity")},
            }
        },
        "business_glossary": [
            {"concept": "open balance", "description": "what a customer owes or a vendor is owed on a day", "distinct_from": "amount"},
            {"concept": "amount", "description": "the face value of a transaction line", "distinct_from": "open balance"},
        ],
    },
    "master_txn_table": {
        "Transaction_ID": {"semantic_role": "transaction_group_identifier", "groups_rows": True},
        "Transaction_DATE": {"semantic_role": "transaction_date", "measure_type": "date", "time_behavior": "event", "use_for": ["when a transaction took place"], "not_for": ["when it is due"]},
        "Due_DATE": {"semantic_role": "due_date", "measure_type": "date", "time_behavior": "event", "use_for": ["when a payment is due"]},
        "CreatedDATE": {"semantic_role": "system_created_date", "measure_type": "date", "not_for": ["when a transaction took place"]},
        "Transaction_TYPE": {"semantic_role": "transaction_type_classifier", "measure_type": "categorical", "value_concepts": {"invoice": "invoice", "bill": "bill", "deposit": "deposit"}, "invalid_value_policy": "unobserved_literal_warning", "literal_match_policy": "case_sensitive_exact_match_preferred"},
        "Amount": _money(warning="has no side; do not use it for net amounts"),
        "Credit": _money(posting_side="credit", requires_account_context=True, sign_convention="unsigned"),
        "Debit": _money(posting_side="debit", requires_account_context=True, sign_convention="unsigned"),
        "Open_balance": _money("stock", financial_role="balance"),
        "Quantity": {"semantic_role": "quantity_measure", "measure_type": "quantity", "unit": "quantity"},
        "Rate": {"semantic_role": "rate_measure", "measure_type": "rate", "unit": "monetary_per_unit"},
        "Account": {"semantic_role": "account_identifier", "entity_scope": "account", "domain_object": "account"},
        "Customers": _party("customer", related_party_role="customer", question_aliases={"client": "customer"}),
        "Vendor": _party("vendor", related_party_role="vendor", question_aliases={"supplier": "vendor"}),
        "Product_Service": {"semantic_role": "product_service_identifier", "entity_scope": "product_service"},
        "payment_method": {"semantic_role": "payment_method_identifier"},
        "AR_paid": {"semantic_role": "settlement_status_flag", "status_dimension": "payment_status", "domain_object": "accounts_receivable", "value_concepts": {"paid": "paid"}, "missing_value_policy": _PAID},
        "AP_paid": {"semantic_role": "settlement_status_flag", "status_dimension": "payment_status", "domain_object": "accounts_payable", "value_concepts": {"paid": "paid"}, "missing_value_policy": _PAID},
    },
    "chart_of_accounts": {
        "Account_name": {"semantic_role": "account_identifier", "entity_scope": "account", "domain_object": "account"},
        "Account_type": {
            "semantic_role": "account_type_classifier",
            "domain_object": "account",
            "value_concepts": {"Accounts Receivable": "accounts_receivable", "Accounts Payable": "accounts_payable", "Income": "income", "Expense": "expense", "Asset": "asset", "Liability": "liability"},
            "concept_metadata": {
                "accounts_receivable": {"financial_element": "asset", "domain_object": "accounts_receivable", "normal_balance": "debit"},
                "accounts_payable": {"financial_element": "liability", "domain_object": "accounts_payable", "normal_balance": "credit"},
                "income": {"financial_element": "income", "domain_object": "income", "normal_balance": "credit"},
                "expense": {"financial_element": "expense", "domain_object": "expense", "normal_balance": "debit"},
                "asset": {"financial_element": "asset", "normal_balance": "debit"},
                "liability": {"financial_element": "liability", "normal_balance": "credit"},
            },
        },
    },
    "customers": {"customer_name": _party("customer"), "customer_full_name": _party("customer"), "Balance": _money("stock", financial_role="balance", financial_element="asset", domain_object="accounts_receivable")},
    "vendors": {"Vendor_name": _party("vendor"), "Balance": _money("stock", financial_role="balance", financial_element="liability", domain_object="accounts_payable")},
    "employees": {"Employee_name": _party("employee"), "Hire_date": {"semantic_role": "entity_date", "measure_type": "date"}, "Billing_rate": {"semantic_role": "rate_measure", "measure_type": "rate", "unit": "monetary_per_unit"}, "Deleted": {"semantic_role": "status_flag", "status_dimension": "record_status"}},
    "products": {"Product_Service": {"semantic_role": "product_service_identifier", "entity_scope": "product_service"}, "Product_Service_type": {"semantic_role": "product_service_classifier"}},
    "payment_method": {"Payment_method": {"semantic_role": "payment_method_identifier"}, "Credit_card": {"semantic_role": "payment_method_attribute"}},
}


def ledger_notes() -> Notes:
    return Notes(LEDGER)
