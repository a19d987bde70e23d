"""Names and fixed values shared by every operator."""

from __future__ import annotations

# ---- Fixed values: these must stay as they are for results to agree. ----

GROUPS = ("outward", "inward", "credit_notes", "debit_notes", "receipts", "payments", "expenses")
INVOICE_GROUPS = ("outward", "inward", "credit_notes", "debit_notes")
TAX_GROUPS = INVOICE_GROUPS + ("expenses",)
OWN_SERIES_GROUPS = ("outward", "credit_notes")
COMPONENTS = ("cgst", "sgst", "igst", "cess")

RATE_SLABS = ("0", "0.1", "0.25", "1", "1.5", "3", "5", "6", "7.5", "12", "18", "28", "40")

TAXONOMY = (
    "Purchase", "Sales", "Expense", "Payment", "Receipt", "Contra", "Receipt Note", "Delivery Note",
    "Rejection In", "Rejection Out", "Import", "Export", "Job Work In Order", "Job Work Out Order",
    "Material In", "Material Out", "Stock Journal", "Physical Stock", "Salary / Payroll", "Attendance",
    "Purchase Order", "Sales Order", "Advance / Prepayment", "Journal", "Other / Miscellaneous",
    "Purchase Return / Debit Note", "Sales Return / Credit Note",
)

GSTIN_REGEX = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

LABEL_COLUMN = "Voucher Category"

# Columns that carry a label or an earlier prediction; removed before analysis.
DROPPED_HEADERS = (
    "voucher category", "voucher_type", "document_type", "target", "correct", "predicted voucher category",
    "model score (uncalibrated)", "top 3 (uncalibrated)", "review required",
)

# Canonical field -> folded headers that map to it.
HEADER_ALIASES = {
    "invoice_number": "invoice number|invoice no|inv no|bill no|bill number|document number|doc no|voucher no|"
                      "voucher number|invoice_number|export invoice no|import bill no|credit note no|debit note no|"
                      "note number",
    "invoice_date": "invoice date|document date|bill date|voucher date|date|transaction date|transaction_date|note date",
    "supplier_name": "supplier|supplier name|vendor name|vendor|seller|seller_supplier|exporter|vendor/provider",
    "customer_name": "customer|customer name|buyer|buyer_customer|importer|party|party name",
    "supplier_gstin": "supplier gstin|vendor gstin|seller gstin|gstin of supplier|supplier_gstin",
    "recipient_gstin": "customer gstin|recipient gstin|buyer gstin|gstin of recipient|customer_gstin|recipient_gstin",
    "party_gstin": "gstin|party gstin|gst number|gstin/uin|gst no|party_gstin",
    "place_of_supply": "place of supply|pos|place_of_supply",
    "hsn_sac": "hsn|hsn/sac|sac|hsn code|hsn_sac",
    "taxable_value": "taxable value|taxable amount|base amount|assessable value|taxable_value",
    "gst_rate": "gst rate|tax rate|gst %|gst rate %|gst_rate_percent|gst_rate|rate of tax",
    "cgst": "cgst|cgst amount|central tax",
    "sgst": "sgst|sgst amount|utgst|sgst/utgst|state tax",
    "igst": "igst|igst amount|integrated tax|import gst",
    "cess": "cess|cess amount",
    "total_tax": "tax amount|gst amount|total tax|gst_amount|total gst",
    "total_amount": "invoice value|invoice amount|total amount|grand total|total invoice value",
    "amount": "amount|payment amount|received amount|amount claimed|transfer amount|total value|net amount",
    "currency": "currency|currency code|payment currency|original currency",
    "original_invoice_ref": "original invoice ref|original doc ref|original invoice|original invoice number|"
                            "original_invoice_number|against invoice|reference invoice",
    "ledger": "ledger|ledger name|account|account name",
    "opening_balance": "opening balance|opening_balance",
    "closing_balance": "closing balance|closing_balance",
    "debit": "debit|debit amount|dr amount",
    "credit": "credit|credit amount|cr amount",
}
MONEY_FIELDS = (
    "taxable_value", "cgst", "sgst", "igst", "cess", "total_tax", "total_amount", "amount", "opening_balance",
    "closing_balance", "debit", "credit",
)
GSTIN_FIELDS = ("supplier_gstin", "recipient_gstin", "party_gstin")

CELL_NULLS = ("nan", "none", "nat", "null")   # accounting cells
FIELD_NULLS = ("nan", "none", "nat")          # rule and text fields

# Canonical training row, in text order.
TRAINING_FIELDS = (
    "seller_supplier", "buyer_customer", "invoice_number", "transaction_date", "item_description",
    "transaction_narration", "quantity", "unit_price", "taxable_value", "gst_rate_percent", "gst_amount",
    "discount_amount", "freight_amount", "currency", "payment_method", "payment_status", "order_reference",
    "return_reason", "debit_credit_info", "payroll_period", "employee_count", "attendance_days",
    "import_export_reference", "customs_duty_amount", "warehouse_from", "warehouse_to", "movement_reason",
    "document_type", "gross_pay_amount", "deductions_amount", "net_pay_amount",
)
TEXT_FIELDS = ("transaction_narration", "item_description")
CATEGORY_FIELDS = (
    "currency", "payment_method", "payment_status", "return_reason", "debit_credit_info", "warehouse_from",
    "warehouse_to", "movement_reason",
)
NUMERIC_FIELDS = (
    "quantity", "unit_price", "taxable_value", "gst_rate_percent", "gst_amount", "discount_amount",
    "freight_amount", "customs_duty_amount", "employee_count", "attendance_days", "gross_pay_amount",
    "deductions_amount", "net_pay_amount",
)
PRESENCE_FIELDS = (
    "seller_supplier", "buyer_customer", "invoice_number", "order_reference", "import_export_reference",
    "payroll_period",
)
CONTRACT_FIELDS = TEXT_FIELDS + CATEGORY_FIELDS + NUMERIC_FIELDS + PRESENCE_FIELDS
RELATION_FIELDS = (
    "rel_qty_x_price_matches_value", "rel_gst_matches_rate", "rel_net_matches_gross_minus_deductions",
)
# Label-bearing names that must not appear among model inputs.
FORBIDDEN_INPUTS = (
    "document_type", "voucher_type", LABEL_COLUMN, "target", "provisional_consensus_label", "Correct",
    "Predicted Voucher Category",
)

# Simple header variants of the training row.
TRAINING_ALIASES = {
    "supplier": "seller_supplier", "vendor": "seller_supplier", "customer": "buyer_customer",
    "narration": "transaction_narration", "description": "item_description", "date": "transaction_date",
    "invoice_no": "invoice_number", "gst_rate": "gst_rate_percent", "gst": "gst_amount", "voucher": "voucher_type",
}

# Wide worksheet columns feeding each training field; the first filled one wins.
WIDE_SOURCES = {
    "seller_supplier": "Supplier|Vendor Name|Exporter|Selling Company|Subcontractor|Payer Organization",
    "buyer_customer": "Customer|Ordering Company|Receiving Company|Importer|Contractor|Payee Organization|Company",
    "transaction_date": "PO Date|Rejection Date|Document Date|Receipt Date|Transaction Date|Payment Date|Order Date|"
                        "Dispatch Date|Entry Date|Claim Date|Adjustment Date|Count Date|SO Date|Date of Dispatch|"
                        "Date of Receipt",
    "item_description": "Item|Product|Item Rejected|Item Received|Item Dispatched|Material Description|Material|"
                        "Export Item|Import Item|Item Name|Description",
    "transaction_narration": "Narration|Transaction Details|Transfer Purpose|Notes|Reason",
    "quantity": "Quantity Required|Quantity Received|Quantity Shipped|Quantity Ordered|Quantity Sent|Quantity|Units|"
                "Book Quantity|Counted Quantity",
    "unit_price": "Unit Rate|Unit Cost|Processing Rate",
    "taxable_value": "Total Value|Base Amount|Transfer Amount|Payment Amount|Received Amount|Amount|Amount Claimed|"
                     "Free on Board Value|Cost Insurance Freight",
    "gst_amount": "Tax Amount|Import GST",
    "customs_duty_amount": "Customs Duty",
    "freight_amount": "Freight Charges|Transport Cost",
    "currency": "Currency Code|Payment Currency|Original Currency",
    "payment_method": "Mode of Payment|Payment Method|Payment Type|Bank Details",
    "payment_status": "Status",
    "order_reference": "PO Reference|SO Reference|Reference PO|Reference Number|Supporting Doc|Delivery Ref|"
                       "GRN Reference|DN Reference",
    "return_reason": "Reason for Return|Rejection Reason",
    "debit_credit_info": "Debit Side|Credit Side",
    "payroll_period": "Payroll Period",
    "gross_pay_amount": "Gross Salary",
    "net_pay_amount": "Net Payable",
}

OWN_ID_COLUMNS = (
    "PO Number", "SO Number", "Rejection Note No", "Document Number", "GRN Number", "Delivery Challan No",
    "Outward Job Work No", "Inward Job Work No", "Contra ID", "Payment ID", "Receipt ID", "Employee Code",
    "Expense Claim No", "Export Invoice No", "Import Bill No", "Journal ID", "Stock Adj ID", "Stock Count ID",
    "JWIO Ref", "JWOO Ref",
)
REFERENCE_ID_COLUMNS = (
    "PO Ref", "PO Reference", "Reference PO", "SO Reference", "DN Reference", "Delivery Ref", "GRN Reference",
    "Original Doc Ref", "Original Invoice Ref", "Against Invoice", "Buyer Invoice", "Consignment Invoice",
    "Transaction Ref", "Reference Number", "Supporting Doc",
)

# Console field pickers: candidate headers in order of preference.
PICK_INVOICE = (
    "Invoice No", "Invoice Number", "Document Number", "Bill No", "PO Number", "SO Number", "Delivery Challan No",
    "GRN Number", "Payment ID", "Receipt ID", "Contra ID", "Journal ID", "Export Invoice No", "Import Bill No",
    "Expense Claim No", "Rejection Note No", "Voucher No",
)
PICK_PARTY = (
    "Party", "Party Name", "Vendor Name", "Customer", "Supplier", "Vendor/Provider", "Payee Organization",
    "Payer Organization", "Exporter", "Importer", "Contractor", "Subcontractor",
)
PICK_AMOUNT = (
    "Invoice Value", "Total Amount", "Total Value", "Base Amount", "Taxable Value", "Amount", "Payment Amount",
    "Received Amount", "Transfer Amount", "Amount Claimed", "Free on Board Value", "Cost Insurance Freight",
)
# ---- End of fixed values. ----

REFS_SHOWN = 50
SAMPLES_SHOWN = 10


def alias_lookup() -> dict[str, str]:
    return {alias: field for field, names in HEADER_ALIASES.items() for alias in names.split("|")}


def wide_sources(field: str) -> list[str]:
    return WIDE_SOURCES[field].split("|")
