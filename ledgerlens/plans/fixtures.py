"""Small ledgers on which a wrong reading of a query shows, and queries that read it wrongly on purpose.

A template is a way to go wrong (sides, parties, classes, counts for sums). It
applies to a reference query that speaks of its subject. Its mutants are the
reference rewritten that way; its fixtures are balanced ledgers in which the
subject's two sides differ. A fixture is fit for a reference if the reference
has something to show there and at least one mutant shows something else; on
such fixtures a candidate must show what the reference shows.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.dataflow import round6
from ledgerlens.operators.joins import even_left_join
from ledgerlens.plans.dialect import DialectError, fold_date
from ledgerlens.plans.execute import Engine, ordered
from ledgerlens.plans.facts import aggregate_of, facts_by_shape
from ledgerlens.plans.notes import Notes, ledger_notes
from ledgerlens.plans.sql import Node, SqlError, parse, render
from ledgerlens.sources.ledger import LEDGER

# Types of transactions, classes of account types, and the accounts that every fixture has.
TYPES = ("invoice", "bill", "deposit")
ACCOUNT_CLASSES = {
    "accounts payable (a/p)": "accounts_payable", "accounts receivable (a/r)": "accounts_receivable", "bank": "asset", "credit card": "liability", "equity": "equity", "expenses": "expense", "fixed assets": "asset",
    "income": "income", "long term liabilities": "liability", "other current assets": "asset", "other current liabilities": "liability", "other expense": "expense", "other income": "income",
}
ACCOUNTS = {
    "Accounts Receivable": "accounts receivable (a/r)", "Accounts Payable": "accounts payable (a/p)", "Sales Income": "income", "Consulting Income": "income", "Cost of Goods Sold": "expenses", "Office Expense": "expenses",
    "Checking": "bank", "Savings": "bank", "Visa Credit Card": "credit card", "Inventory Asset": "other current assets", "Equipment": "fixed assets", "Payroll Liabilities": "other current liabilities", "Bank Loan": "long term liabilities", "Owner Equity": "equity",
}
AS_OF = "2026-06-23"


@dataclass(frozen=True)
class Template:
    """A way to go wrong: what a reference must speak of, how mutants are made, and the columns whose predicates a mutant drops."""

    columns: frozenset = frozenset()
    concepts: frozenset = frozenset()
    counts: bool = False
    literals: frozenset = frozenset()
    parties: bool = False
    families: tuple = ()
    tied: frozenset = frozenset()


def _f(*names: str) -> frozenset:
    return frozenset(names)


_PARTY = _f("customers", "customer_name", "customer_full_name", "vendor", "vendor_name")
# Templates with their families of mutants.
TEMPLATES: dict[str, Template] = {
    "posting_side_debit_credit": Template(columns=_f("credit", "debit"), families=(("swap_credit_debit", "columns", {"credit": "Debit", "debit": "Credit"}),), tied=_f("credit", "debit")),
    "ar_ap_scope": Template(
        columns=_f("ar_paid", "ap_paid"), concepts=_f("accounts_receivable", "accounts_payable"), tied=_f("ar_paid", "ap_paid", "account_type"),
        families=(("swap_ar_ap_status", "columns", {"ar_paid": "AP_paid", "ap_paid": "AR_paid"}), ("swap_ar_ap_concepts", "literals", {"accounts receivable (a/r)": "Accounts Payable (A/P)", "accounts payable (a/p)": "Accounts Receivable (A/R)"})),
    ),
    "income_expense_scope": Template(
        concepts=_f("income", "expense"), tied=_f("account_type"),
        families=(("swap_income_expense_values", "literals", {"income": "Expenses", "other income": "Other Expense", "expenses": "Income", "expense": "Income", "other expense": "Other Income"}), ("remove_account_type_predicate", "drop", None)),
    ),
    "asset_liability_scope": Template(
        concepts=_f("asset", "liability", "accounts_receivable", "accounts_payable"), tied=_f("account_type"),
        families=(
            ("swap_asset_liability_values", "literals", {"other current assets": "Other Current Liabilities", "fixed assets": "Long Term Liabilities", "bank": "Credit Card", "credit card": "Bank", "accounts receivable (a/r)": "Accounts Payable (A/P)", "accounts payable (a/p)": "Accounts Receivable (A/R)"}),
            ("remove_asset_liability_predicate", "drop", None),
        ),
    ),
    "balance_count_status_proxy": Template(
        columns=_f("open_balance", "balance", "ar_paid", "ap_paid"), counts=True, tied=_f("open_balance", "ar_paid", "ap_paid"),
        families=(
            ("replace_balance_with_count", "sum", (_f("open_balance", "balance"), "COUNT(*)")), ("replace_count_with_balance", "count", (None, "SUM(Open_balance)")),
            ("replace_count_with_status", "count", (None, "SUM(CASE WHEN AR_paid = 'paid' OR AP_paid = 'paid' THEN 1 ELSE 0 END)")), ("replace_open_balance_with_amount", "columns", {"open_balance": "Amount"}),
        ),
    ),
    "quantity_transaction_count": Template(
        columns=_f("quantity", "transaction_id"), counts=True, tied=_f("quantity", "transaction_id"),
        families=(
            ("replace_quantity_with_count", "sum", (_f("quantity"), "COUNT(*)")), ("replace_quantity_with_distinct_transactions", "sum", (_f("quantity"), "COUNT(DISTINCT Transaction_ID)")),
            ("count_rows_to_distinct_transactions", "count", (True, "COUNT(DISTINCT Transaction_ID)")), ("count_distinct_to_rows", "count", (False, "COUNT(*)")),
        ),
    ),
    "transaction_type_scope": Template(literals=frozenset(TYPES), tied=_f("transaction_type"), families=(("swap_transaction_type_literals", "literals", {"invoice": "bill", "bill": "deposit", "deposit": "invoice"}), ("remove_transaction_type_predicate", "drop", None))),
    "customer_vendor_scope": Template(
        columns=_PARTY, parties=True, tied=_PARTY,
        families=(("swap_customer_vendor_columns", "columns", {"customers": "Vendor", "customer_name": "Vendor_name", "customer_full_name": "Vendor_name", "vendor": "Customers", "vendor_name": "customer_name"}), ("remove_party_predicate", "drop", None)),
    ),
}


# What a reference speaks of


@dataclass
class Evidence:
    columns: set[str] = field(default_factory=set)
    literals: dict[str, set[str]] = field(default_factory=dict)
    concepts: set[str] = field(default_factory=set)
    parties: set[str] = field(default_factory=set)
    dates: list[tuple[str, str, list]] = field(default_factory=list)
    counts: bool = False
    measures: set[str] = field(default_factory=set)
    substrings: set[str] = field(default_factory=set)
    error: str | None = None
    unsupported: bool = False

    def of(self, *columns: str) -> set[str]:
        return set().union(*(self.literals.get(c, set()) for c in columns))


def evidence_of(sql: str | None, notes: Notes | None = None) -> Evidence:
    """What a query names: columns, the literals that each is compared with (either way round, in lists and ranges), classes, parties, dates, counts."""
    notes = notes or ledger_notes()
    facts = facts_by_shape(sql)
    out = Evidence(error=facts["error"], unsupported=bool(facts["unsupported_lineage"]))
    if out.error:
        return out
    tree = parse(sql)
    out.columns = {c.text.lower() for c in tree.walk("column") if not c["quoted"]}
    out.counts = any(a["func"] == "count" for a in facts["aggregations"])
    out.measures = {r["column"].lower() for o in facts["outputs"] for r in o["columns"]}
    for n in tree.walk("binary", "in", "between", "like"):
        names = [i.text.lower() for i in n.items if i.kind == "column" and not i["quoted"]]
        texts = [i.text for i in n.items if i.kind == "string" or i.kind == "column" and i["quoted"]]
        if len(names) == 1 and texts and (n.kind != "binary" or n.text in ("=", "!=")):
            out.literals.setdefault(names[0], set()).update(texts)
    for call in tree.walk("call"):
        if call.text.lower() == "instr" and len(call.items) == 2 and call.items[0].text.lower() in ("account", "account_name"):
            out.substrings.add(call.items[1].text)
    lowered = {a.lower(): c for a, c in ACCOUNTS.items()}
    types = [x.lower() for x in out.of("account_type")] + [lowered[a.lower()] for a in out.of("account", "account_name") if a.lower() in lowered]
    out.concepts = {ACCOUNT_CLASSES.get("expenses" if t == "expense" else t) for t in types} - {None}
    for f in facts["filters"]:
        for ref in f["columns"]:
            for note in notes.find(ref["column"], ref["table"], facts["tables"]):
                if note.get("semantic_role") == "settlement_status_flag" and note.get("domain_object"):
                    out.concepts.add(note.get("domain_object"))
                if note.get("entity_scope"):
                    out.parties.add(note.get("entity_scope"))
                if note.get("semantic_role") in ("transaction_date", "due_date", "system_created_date"):
                    out.dates.append((ref["column"].lower(), f["operator"], f["column_values"]))
    return out


def applicable(evidence: Evidence) -> list[str]:
    """Templates whose subject a query speaks of; none for a query that cannot be read or is nested."""
    if evidence.error or evidence.unsupported:
        return []
    fits = lambda t: bool(evidence.columns & t.columns or evidence.concepts & t.concepts or t.counts and evidence.counts or {x.lower() for x in evidence.of("transaction_type")} & t.literals or t.parties and evidence.parties & {"customer", "vendor"})
    return sorted(name for name, t in TEMPLATES.items() if fits(t))


# Mutants


def _without(node: Node, tied: frozenset) -> Node | None:
    """A condition without the parts of its AND that speak of some columns."""
    if node.kind == "paren":
        inner = _without(node.items[0], tied)
        return inner and Node("paren", items=[inner])
    if node.kind == "binary" and node.text == "AND":
        parts = [p for p in (_without(i, tied) for i in node.items) if p]
        return None if not parts else parts[0] if len(parts) == 1 else Node("binary", "AND", parts)
    return None if {c.text.lower() for c in node.walk("column")} & tied else node


def _mutant(tree: Node, how: str, what, tied: frozenset) -> Node | None:
    if how == "drop":
        if tree.kind != "select" or not tree["where"]:
            return None
        left = _without(tree["where"].copy(), tied)
        out = tree.copy()
        if left is None:
            return None
        out.more["where"] = left
        return out
    replaced = parse(f"SELECT {what[1]}").items[0] if how in ("sum", "count") else None

    def change(n: Node) -> Node | None:
        if how == "columns" and n.kind == "column" and not n["quoted"] and n.text.lower() in what:
            return Node("column", what[n.text.lower()], more=dict(n.more))
        if how == "literals" and n.kind == "string" and n.text.strip().lower() in what:
            return Node("string", what[n.text.strip().lower()])
        if how == "sum" and aggregate_of(n) == "sum" and {c.text.lower() for c in n.walk("column")} & what[0]:
            return replaced.copy()
        if how == "count" and aggregate_of(n) == "count":
            star = bool(n.items) and n.items[0].kind == "star"
            return replaced.copy() if what[0] is None or what[0] == star else None
        return None

    return tree.copy(change)


def mutants(sql: str, template: str) -> list[tuple[str, str | None, str | None]]:
    """A template's mutants of a query: (family, query or None, why there is none); each query once."""
    families = TEMPLATES[template].families
    try:
        tree = parse(sql)
    except SqlError as e:
        return [(name, None, f"parse_error: {e}") for name, _, _ in families]
    plain, out = render(tree), []
    for name, how, what in families:
        made = _mutant(tree, how, what, TEMPLATES[template].tied)
        text = render(made) if made else None
        known = {plain, *(t for _, t, _ in out)}
        out.append((name, None, "no_safe_rewrite_or_no_change") if text is None or text in known else (name, text, None))
    return out


# What a fixture must hold


def clamped(date: str, lower: str | None, upper: str | None) -> str:
    """A day inside bounds: the day itself if it lies there, else the lower bound, else the upper."""
    if (not lower or date >= lower) and (not upper or date <= upper):
        return date
    return lower if lower and (not upper or lower <= upper) else upper or date


def clamped_day(day: Column, lower: Column, upper: Column) -> Column:
    """``clamped`` as a column of ISO days."""
    inside = (lower.isNull() | (day >= lower)) & (upper.isNull() | (day <= upper))
    return F.when(inside, day).when(lower.isNotNull() & (upper.isNull() | (lower <= upper)), lower).otherwise(F.coalesce(upper, day))


def resolved_day(value, as_of: str) -> str | None:
    """The day that a literal or a date expression of literals names."""
    text = str(value or "").strip()
    if re.match(r"'?\d{4}-\d{2}-\d{2}", text):
        return text.strip("'")[:10]
    try:
        n = parse(f"SELECT {text}").items[0]
    except SqlError:
        return None
    if n.kind == "now":
        return as_of
    if n.kind != "call" or n.text.lower() != "date" or any(i.kind not in ("string", "now") for i in n.items):
        return None
    try:
        return fold_date([f"'{i.text}'" if i.kind == "string" else "current_date" for i in n.items], as_of)
    except DialectError:
        return None


def needs_of(evidence: Evidence, as_of: str = AS_OF) -> dict:
    """What a fixture must hold for a reference to show something: literals by column, a day, and what cannot be had."""
    lower = upper = None
    missing: list[tuple[str, str]] = []
    for column, operator, values in evidence.dates:
        days = [resolved_day(v, as_of) for v in values]
        if column != "transaction_date":
            missing.append(("date", "date_predicate_not_transaction_date"))
        elif operator not in ("BETWEEN", "=", ">", ">=", "<", "<=") or not days or operator == "BETWEEN" and len(days) != 2:
            missing.append(("date", "unsupported_date_predicate"))
        elif None in days:
            missing.append(("date", "unsupported_date_boundary"))
        elif operator in ("BETWEEN", "="):
            lower, upper = days[0], days[-1]
        elif operator[0] == ">":
            lower = days[0]
        else:
            upper = days[0]
    types = evidence.of("transaction_type")
    missing += [("transaction_type", "unknown_transaction_type_literal") for t in types if t not in TYPES]
    missing += [("account_type", "unknown_account_type_literal") for t in evidence.of("account_type") if t.lower() not in ACCOUNT_CLASSES and t.lower() != "expense"]
    return {
        "literals": {c: sorted(v) for c, v in sorted(evidence.literals.items())}, "substrings": sorted(evidence.substrings), "concepts": sorted(evidence.concepts), "from": lower, "to": upper,
        "day": clamped(as_of, lower, upper), "missing": missing, "types": sorted(t for t in types if t in TYPES), "measures": sorted(evidence.measures), "counts": evidence.counts,
    }


#: Fitting accounts that are sent to the lines, at most.
ACCOUNTS_SENT = 10_000
#: Columns of other tables whose values the ledger's lines hold under another name.
_HELD = {"customer_name": "customers", "customer_full_name": "customers", "vendor_name": "vendor", "account_name": "account"}


def supported_rows(lines: DataFrame, needs: dict, date: str = "Transaction_DATE", accounts: DataFrame | None = None) -> DataFrame:
    """Ledger lines that a reference's literals, account substrings and dates allow: whether a ledger can show anything.

    Account types are looked up in ``accounts`` (chart of accounts) by business
    and account, after all else has thinned out the lines; of a chart of up to
    ``ACCOUNTS_SENT`` fitting accounts these go to the lines, which stay where
    they are. A literal of a column that neither table has is an error.
    """
    types = {v.lower() for v in needs["literals"].get("account_type", [])}
    out, columns = lines, lines.columns
    if types and accounts is None:
        raise ValueError("account types need the chart of accounts")
    names = {c.lower(): c for c in columns}
    for column, values in needs["literals"].items():
        own = names.get(column.lower()) or names.get(_HELD.get(column.lower(), ""))
        if column.lower() == "account_type" or not values:
            continue
        if own is None:
            raise ValueError(f"no column for the literals of {column}")
        out = out.where(F.lower(own).isin(*[v.lower() for v in values]))
    for text in needs.get("substrings", []):
        out = out.where(F.contains(F.lower(names["account"]), F.lit(text.lower())))
    if needs.get("from"):
        out = out.where(F.col(date) >= F.lit(needs["from"]).cast("date"))
    if needs.get("to"):
        out = out.where(F.col(date) <= F.lit(needs["to"]).cast("date"))
    if not types:
        return out
    by = [c for c in ("businessID",) if c.lower() in names and c in accounts.columns]
    on = [*by, names["account"]]
    fits = accounts.where(F.lower("Account_type").isin(*types) & F.col("Account_name").isNotNull()).select(*by, F.col("Account_name").alias(names["account"])).distinct()
    sent = fits.limit(ACCOUNTS_SENT + 1).collect()
    if len(sent) <= ACCOUNTS_SENT:
        return out.join(F.broadcast(lines.sparkSession.createDataFrame(sent, fits.schema)), on, "left_semi").select(*columns)
    return even_left_join(out, fits.withColumn("_fits", F.lit(True)), on).where("_fits").select(*columns)


# Fixtures


@dataclass(frozen=True)
class Entry:
    """A balanced transaction: one line on each of two accounts."""

    type: str
    amount: float
    debit: str
    credit: str
    party: tuple[str | None, str | None] = (None, None)
    product: str | None = None
    quantity: int | None = None
    paid: str | None = "paid"
    open: float | None = None
    method: str = "Cash"


# Transactions in which the two sides of every template differ: no two amounts are equal.
BASE = (
    Entry("invoice", 721, "Accounts Receivable", "Sales Income", ("North Bakery", None), "Catering", 6, "paid", 334),
    Entry("bill", 258, "Office Expense", "Accounts Payable", (None, "Paper House"), "Printing", 4, "paid", 97),
    Entry("deposit", 136, "Checking", "Owner Equity", open=136, paid=None),
)
STRESS = (
    Entry("invoice", 869, "Accounts Receivable", "Sales Income", ("South Cinema", None), "Catering", 9, "paid", 869),
    Entry("bill", 347, "Cost of Goods Sold", "Accounts Payable", (None, "Harbour Storage"), "Printing", 14, "paid", 347),
    Entry("deposit", 118, "Checking", "Payroll Liabilities", open=118, paid=None),
    Entry("invoice", 59, "Inventory Asset", "Consulting Income", ("North Bakery", None), "Catering", 17, "--", 59),
)
CONTRAST = (
    Entry("invoice", 943, "Accounts Receivable", "Sales Income", ("North Bakery", None), "Catering", 19, "paid", 943),
    Entry("bill", 412, "Office Expense", "Accounts Payable", (None, "Paper House"), "Printing", 4, "paid", 412),
    Entry("deposit", 151, "Checking", "Payroll Liabilities", quantity=3, open=151, paid=None),
    Entry("invoice", 83, "Inventory Asset", "Consulting Income", ("South Cinema", None), "Catering", 27, "--", 83),
    Entry("bill", 577, "Cost of Goods Sold", "Visa Credit Card", (None, "Harbour Storage"), "Printing", 8, "paid", 577),
)
#: States of a template's fixture: the common transactions, with more of one kind in each.
STATES = {"plain": BASE + STRESS, "contrast": BASE + STRESS + CONTRAST, "doubled": BASE + CONTRAST + CONTRAST}


def seeded(entries: tuple[Entry, ...], needs: dict) -> Iterator[Entry]:
    """Transactions with a reference's literals in the places of the usual ones, so that it has something to show: each with its contrast."""
    yield from entries
    of = lambda *names: [v for n in names for v in needs["literals"].get(n, [])]
    customers, vendors = of("customers", "customer_name", "customer_full_name") or [None], of("vendor", "vendor_name") or [None]
    accounts = of("account", "account_name") + [f"Seed {s}" for s in needs["substrings"]] + [f"Seed {t}" for t in of("account_type") if t.lower() in ACCOUNT_CLASSES or t.lower() == "expense"]
    products, methods, statuses = of("product_service") or ["Catering"], of("payment_method") or ["Cash"], sorted(set(of("ar_paid") + of("ap_paid"))) or ["paid"]
    for n, kind in enumerate(needs["types"] or TYPES):
        for k, account in enumerate(accounts or ["Checking", "Office Expense"]):
            amount = 123 + 17 * n + 31 * k
            party = (customers[0] or "North Bakery", None) if kind != "bill" else (customers[0], vendors[0] or "Paper House")
            if customers[0] and vendors[0]:
                party = customers[0], vendors[0]
            for status in statuses:
                yield Entry(kind, amount, account, "Owner Equity", party, products[0], 4 + n + k, status, amount / 2, methods[0])
                yield Entry(kind, amount + 7, "Owner Equity", account, party, products[0], 9 + n + k, status, amount / 4, methods[0])


def accounts_for(needs: dict) -> dict[str, str | None]:
    """Accounts by name with their types: the usual ones, and those that literals name."""
    out: dict[str, str | None] = dict(ACCOUNTS)
    for name in needs["literals"].get("account", []) + needs["literals"].get("account_name", []):
        out.setdefault(name, "other current assets")
    for text in needs["substrings"]:
        out.setdefault(f"Seed {text}", "other current assets")
    for kind in needs["literals"].get("account_type", []):
        out.setdefault(f"Seed {kind}", kind)
    return out


def fixture_rows(needs: dict, entries: tuple[Entry, ...]) -> dict[str, list[tuple]]:
    """The rows of the seven tables of a balanced ledger that holds what is needed."""
    day = dt.date.fromisoformat(needs["day"])
    every = list(seeded(entries, needs))
    lines = []
    for n, e in enumerate(every):
        for side, account in ((0, e.debit), (1, e.credit)):
            opened = e.open if e.open is not None and (account in ("Accounts Receivable", "Accounts Payable", "Checking", "Inventory Asset", "Visa Credit Card") or account.startswith("Seed ")) else 0.0
            ar, ap = (e.paid, None) if e.type == "invoice" else (None, e.paid) if e.type == "bill" else (e.paid if e.party[0] else None, e.paid if e.party[1] else None)
            rate = e.amount / e.quantity if e.quantity else None
            lines.append((2 * n + side + 1, 1, 1000 + n, day, e.type, float(e.amount), day, "fixture", account, ar, ap, day, float(opened), *e.party, e.product, e.quantity, rate, float(e.amount) if side else 0.0, 0.0 if side else float(e.amount), e.method, None))
    accounts = accounts_for(needs)
    unique = lambda values: sorted({v for v in values if v})
    where = ("1 Main", "NYC", "NY", 10001)
    return {
        "chart_of_accounts": [(n, 1, a, t) for n, (a, t) in enumerate(accounts.items(), 1)],
        "customers": [(n, 1, c, c, *where, *where, 100.0 * n) for n, c in enumerate(unique(["North Bakery", "South Cinema", *(e.party[0] for e in every)]), 1)],
        "employees": [(1, "1", "Staff One", "E-1", dt.date(2024, 1, 1), None, "no")],
        "master_txn_table": lines,
        "payment_method": [(n, "1", m, "no") for n, m in enumerate(unique(["Cash", "Credit Card", *(e.method for e in every)]), 1)],
        "products": [(n, "1", p, "service") for n, p in enumerate(unique(["Catering", "Printing", *(e.product for e in every)]), 1)],
        "vendors": [(n, "1", v, *where, 120.0 * n) for n, v in enumerate(unique(["Paper House", "Harbour Storage", *(e.party[1] for e in every)]), 1)],
    }


def fixture(spark: SparkSession, needs: dict, entries: tuple[Entry, ...]) -> dict[str, DataFrame]:
    """The seven tables of a balanced ledger that holds what is needed."""
    return {name: spark.createDataFrame(own, LEDGER[name]) for name, own in fixture_rows(needs, entries).items()}


def known_literals(needs: dict) -> set[str]:
    """The literals that the first state of a fixture holds, in lower case."""
    rows = fixture_rows(needs, next(iter(STATES.values())))
    places = (("chart_of_accounts", 2), ("chart_of_accounts", 3), ("customers", 2), ("vendors", 2), ("products", 2), ("payment_method", 2))
    return {*ACCOUNT_CLASSES, *TYPES, "paid", "--", *(str(r[k]).lower() for name, k in places for r in rows[name])}


def imbalanced(lines: DataFrame) -> DataFrame:
    """Transactions whose debits and credits differ in six digits."""
    sums = lines.groupBy("Transaction_ID").agg(F.coalesce(F.sum("Debit"), F.lit(0.0)).alias("debit"), F.coalesce(F.sum("Credit"), F.lit(0.0)).alias("credit"))
    return sums.where(round6(F.col("debit")) != round6(F.col("credit")))


def orphans(lines: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Values of a column, with their rows, that its parent table does not have."""
    known = parents.select(F.col(key).alias("key")).distinct()
    return lines.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).join(known, "key", "left_anti")


def integrity_faults(tables: dict[str, DataFrame]) -> list[str]:
    """What is wrong with a ledger: unknown types, values without a parent, transactions out of balance."""
    lines, out = tables["master_txn_table"], []
    if not lines.where(~F.col("Transaction_TYPE").isin(*TYPES)).isEmpty():
        out.append("transaction types")
    for column, parent, key in (("Account", "chart_of_accounts", "Account_name"), ("Customers", "customers", "customer_name"), ("Vendor", "vendors", "Vendor_name"), ("Product_Service", "products", "Product_Service"), ("payment_method", "payment_method", "Payment_method")):
        if not orphans(lines, column, tables[parent], key).isEmpty():
            out.append(f"{column} without {parent}")
    return out + ([] if imbalanced(lines).isEmpty() else ["transactions out of balance"])


def preflight(lines: DataFrame) -> DataFrame:
    """Whether a ledger tells the two sides of each template apart: template, discriminative, and the sums that say so; one pass."""
    c = F.col
    total = lambda test, column: F.coalesce(F.sum(F.when(test, c(column))), F.lit(0.0))
    account = lambda *names: c("Account").isin(*names)
    held = lines.agg(
        total(account("Accounts Receivable"), "Debit").alias("debit"), total(account("Accounts Receivable"), "Credit").alias("credit"), total(account("Accounts Receivable"), "Open_balance").alias("ar"), total(account("Accounts Payable"), "Open_balance").alias("ap"),
        total(account("Sales Income", "Consulting Income"), "Credit").alias("income"), total(account("Office Expense", "Cost of Goods Sold"), "Debit").alias("expense"),
        total(account("Checking", "Inventory Asset", "Accounts Receivable"), "Open_balance").alias("asset"), total(account("Accounts Payable", "Payroll Liabilities"), "Open_balance").alias("liability"),
        F.coalesce(F.sum("Open_balance"), F.lit(0.0)).alias("balance"), F.count("*").cast("double").alias("rows"), F.count_if((c("AR_paid") == "paid") | (c("AP_paid") == "paid")).cast("double").alias("paid"),
        F.coalesce(F.sum("Quantity"), F.lit(0)).cast("double").alias("quantity"), F.count_distinct("Transaction_ID").cast("double").alias("transactions"),
        *[total(c("Transaction_TYPE") == t, "Amount").alias(t) for t in TYPES], F.count_distinct(F.when(c("Transaction_TYPE").isin(*TYPES), c("Transaction_TYPE"))).alias("types"),
        total(c("Customers").isNotNull(), "Amount").alias("customer"), total(c("Vendor").isNotNull(), "Amount").alias("vendor"),
    )
    differ = lambda *names: F.size(F.array_distinct(F.array(*map(c, names)))) == len(names)
    tests = {
        "posting_side_debit_credit": (differ("debit", "credit"), ("debit", "credit")), "ar_ap_scope": (differ("ar", "ap"), ("ar", "ap")), "income_expense_scope": (differ("income", "expense"), ("income", "expense")),
        "asset_liability_scope": (differ("asset", "liability"), ("asset", "liability")), "balance_count_status_proxy": ((c("balance") != c("rows")) & (c("balance") != c("paid")), ("balance", "rows", "paid")),
        "quantity_transaction_count": ((c("quantity") != c("rows")) & (c("quantity") != c("transactions")), ("quantity", "rows", "transactions")), "transaction_type_scope": ((c("types") == len(TYPES)) & differ(*TYPES), TYPES),
        "customer_vendor_scope": ((c("customer") > 0) & (c("vendor") > 0) & differ("customer", "vendor"), ("customer", "vendor")),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("template"), test.alias("discriminative"), F.to_json(F.struct(*names)).alias("sums")) for name, (test, names) in tests.items()])
    return held.select(F.explode(rows).alias("t")).select("t.*")


# Verdicts


def unseeded(made: Evidence, tables: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """Literals of a candidate that no table of a fixture holds: (column, literal)."""
    known: set[str] = set(ACCOUNT_CLASSES)
    for name, column in (("chart_of_accounts", "Account_name"), ("chart_of_accounts", "Account_type"), ("customers", "customer_name"), ("vendors", "Vendor_name"), ("products", "Product_Service"), ("payment_method", "Payment_method")):
        known |= {str(r[0]).lower() for r in tables[name].select(column).collect()}  # a fixture
    known |= {*TYPES, "paid", "--"}
    return sorted((c, v) for c, own in made.literals.items() for v in own if v.lower() not in known)


def _same(gold: tuple, made: tuple, sql: str) -> bool:
    return made[0] is None and gold[4 if ordered(sql) else 5] == made[4 if ordered(sql) else 5]


def accounting_verdict(spark: SparkSession, gold: str, made: str, notes: Notes | None = None, as_of: str = AS_OF) -> dict:
    """Whether a candidate means what its reference means, on fixtures that tell wrong readings apart: 1, 0, or None where nothing could be tested.

    Keys: eq_acct, applicable, tested, failed (templates), reasons (why
    something was not tested, counted), states (of each: template, state, reason or None), mutants (of each: template, family, state that tells it apart).
    """
    evidence = evidence_of(gold, notes)
    out: dict = {"eq_acct": None, "applicable": [], "tested": [], "failed": [], "reasons": {}, "states": [], "mutants": [], "failures": [], "unseeded": []}

    def reason(name: str) -> None:
        out["reasons"][name] = out["reasons"].get(name, 0) + 1

    if evidence.error or evidence.unsupported:
        reason("unsupported_sql_feature")
        return out
    out["applicable"] = applicable(evidence)
    if not out["applicable"]:
        reason("no_applicable_template")
        return out
    needs = needs_of(evidence, as_of)
    engines, shown = {}, {}
    try:
        for name, entries in STATES.items():
            tables = fixture(spark, needs, entries)
            engines[name] = Engine(spark, tables, as_of)
            out["unseeded"] = out["unseeded"] or unseeded(evidence_of(made, notes), tables)
            shown[name] = engines[name].run(gold)
        fit = []
        for name, (error, n, empty, preview, *_) in shown.items():
            why = "unsupported_gold_requirement" if needs["missing"] else "gold_error" if error else "gold_empty" if not n else "gold_all_null" if empty else "gold_zero_count" if evidence.counts and preview.endswith('"rows": [[0]]}') else None
            out["states"].append({"state": name, "reason": why})
            fit.append(name) if why is None else reason(why)
        for template in out["applicable"]:
            if not fit:
                reason("no_valid_fixture_state")
                continue
            made_wrong = [(f, text) for f, text, _ in mutants(gold, template) if text]
            if not made_wrong:
                reason("mutant_generation_not_supported")
                continue
            told = [(f, next((s for s in fit if (r := engines[s].run(text))[0] is None and not _same(shown[s], r, gold)), None)) for f, text in made_wrong]
            out["mutants"] += [{"template": template, "family": f, "state": s} for f, s in told]
            if not any(s for _, s in told):
                reason("mutants_not_distinguished")
                continue
            out["tested"].append(template)
            for s in fit:
                r = engines[s].run(made)
                if not _same(shown[s], r, gold):
                    why = "timeout" if (r[0] or "").startswith("query_timeout") else "generated_execution_error" if r[0] else "generated_mismatch"
                    out["failures"].append({"template": template, "state": s, "reason": why})
            if any(f["template"] == template for f in out["failures"]):
                out["failed"].append(template)
        out["eq_acct"] = 0 if out["failed"] else 1 if out["tested"] else None
        return out
    finally:
        for engine in engines.values():
            engine.close()


def suite_report(rows: DataFrame) -> DataFrame:
    """Figures of verdicts (applicable, tested, failed: lists of templates; eq_acct; execution_match): by template, how often it applied, was tested and failed."""
    listed = F.explode(F.flatten(F.array(*[F.transform(c, lambda t, c=c: F.struct(t.alias("template"), F.lit(c).alias("what"))) for c in ("applicable", "tested", "failed")])))
    return rows.select(listed.alias("x")).groupBy("x.template").agg(*[F.count_if(F.col("x.what") == w).alias(w) for w in ("applicable", "tested", "failed")])


def suite_totals(rows: DataFrame) -> DataFrame:
    """Rows tested and passed, the rate of both, and how many that execution calls right are told apart."""
    from ledgerlens.operators.reports import tallied

    tested = F.size("tested") > 0
    counts = {
        "total": F.count(F.lit(1)), "tested_rows": F.count_if(tested), "passed": F.count_if(tested & (F.col("eq_acct") == 1)), "ex_pass": F.count_if(F.coalesce("execution_match", F.lit(False))),
        "ex_pass_failed": F.count_if(tested & (F.col("eq_acct") == 0) & F.coalesce("execution_match", F.lit(False))),
    }
    return tallied(rows, counts, {"accuracy": ("passed", "tested_rows"), "testability": ("tested_rows", "total"), "ex_pass_fail_rate": ("ex_pass_failed", "ex_pass")})


def failure_audit(rows: DataFrame) -> DataFrame:
    """Why templates were not tested, counted: (reason, n)."""
    return rows.select(F.explode("reasons").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))
