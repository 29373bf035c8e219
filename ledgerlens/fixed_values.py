"""Word lists, lookup tables and constants that decide results."""

# Weight of a merchant category; any other text counts UNKNOWN_CATEGORY.
MERCHANT_CATEGORIES = {
    "retail": 0.1,
    "grocery": 0.15,
    "restaurant": 0.2,
    "gas": 0.25,
    "travel": 0.4,
    "entertainment": 0.35,
    "utilities": 0.1,
    "healthcare": 0.15,
    "education": 0.1,
    "transfer": 0.5,
    "withdrawal": 0.45,
    "online": 0.55,
    "foreign": 0.7,
    "gambling": 0.8,
    "crypto": 0.75,
}
UNKNOWN_CATEGORY = 0.3

# The 15 transaction features in vector order, with the stored mean and deviation of each.
TRANSACTION_FEATURES = [
    ("amount", 500000.0, 1000000.0),
    ("amount_ratio", 1.0, 2.0),
    ("hour", 12.0, 6.0),
    ("day_of_week", 2.5, 2.0),
    ("is_weekend", 0.28, 0.45),
    ("is_after_hours", 0.25, 0.43),
    ("customer_age_days", 365.0, 300.0),
    ("transaction_count_30d", 15.0, 10.0),
    ("avg_amount_30d", 500000.0, 800000.0),
    ("merchant_category", 0.3, 0.25),
    ("same_device", 0.8, 0.4),
    ("distance_from_prev", 5.0, 20.0),
    ("minutes_since_prev", 60.0, 120.0),
    ("failed_attempts_24h", 0.1, 0.5),
    ("unique_merchants_7d", 5.0, 4.0),
]

# What a missing (or zero) history entry counts as.
DEFAULT_AGE_DAYS = 365
DEFAULT_COUNT_30D = 10
DEFAULT_MINUTES = 60
DEFAULT_MERCHANTS_7D = 5

# Known column names of the twelve core fields, in matching order.
CORE_NAMES = {
    "loan_id": [
        "loan_id", "loanid", "loan_no", "loan_number", "loan_ref", "reference",
        "loan_reference", "contract_id", "contract_no", "application_id",
        "disbursement_id", "txn_id", "transaction_id", "id", "ref_no",
    ],
    "borrower_id": [
        "borrower_id", "borrowerid", "member_id", "memberid", "client_id",
        "clientid", "customer_id", "customerid", "member_no", "member_number",
        "client_no", "account_no", "account_number", "sacco_no",
    ],
    "borrower_name": [
        "borrower_name", "borrowername", "name", "full_name", "fullname",
        "member_name", "membername", "client_name", "clientname",
        "customer_name", "customername", "applicant_name", "applicant",
    ],
    "phone": [
        "phone", "phone_number", "phonenumber", "mobile", "mobile_number",
        "mobilenumber", "telephone", "tel", "contact", "contact_number",
        "cell", "cellphone", "phone_no", "tel_no", "mobile_no",
    ],
    "national_id": [
        "national_id", "nationalid", "national_id_no", "nin", "id_no",
        "id_number", "idno", "national_identification", "id_card",
        "identification", "nid", "govt_id", "government_id",
    ],
    "amount": [
        "amount", "loan_amount", "loanamount", "principal", "principal_amount",
        "disbursed_amount", "disbursement", "approved_amount", "requested_amount",
        "credit_amount", "facility_amount", "sum", "total", "value",
    ],
    "loan_date": [
        "loan_date", "loandate", "disbursement_date", "date_disbursed",
        "issue_date", "created_date", "application_date", "approved_date",
        "date", "transaction_date", "txn_date", "start_date",
    ],
    "approval_time": [
        "approval_time", "time", "created_at", "timestamp", "datetime",
        "approved_time", "creation_time", "entry_time",
    ],
    "officer_id": [
        "officer_id", "officerid", "loan_officer_id", "staff_id", "staffid",
        "employee_id", "employeeid", "user_id", "userid", "approved_by",
        "created_by", "processed_by", "agent_id", "agent_code",
    ],
    "officer_name": [
        "officer_name", "officername", "loan_officer", "loanofficer",
        "staff_name", "staffname", "approved_by_name", "agent_name",
    ],
    "branch": [
        "branch", "branch_name", "branchname", "branch_id", "branchid",
        "branch_code", "location", "office", "center", "unit",
    ],
    "status": [
        "status", "loan_status", "loanstatus", "state", "current_status",
        "account_status", "disbursement_status",
    ],
}

# Known column names of the ten further fields.
FURTHER_NAMES = {
    "disbursement_date": [
        "disbursement_date", "disbursed_date", "date_disbursed",
        "payout_date", "release_date", "date_released",
    ],
    "guarantor_name": [
        "guarantor_name", "guarantorname", "guarantor", "witness",
        "reference_name", "referee_name", "co_applicant",
    ],
    "guarantor_phone": [
        "guarantor_phone", "guarantorphone", "guarantor_mobile",
        "guarantor_contact", "referee_phone", "witness_phone",
    ],
    "repayment_amount": [
        "repayment_amount", "repayment", "installment", "monthly_payment",
        "emi", "periodic_payment", "payment_amount",
    ],
    "interest_rate": ["interest_rate", "interestrate", "rate", "int_rate", "interest"],
    "term_months": [
        "term_months", "term", "tenure", "loan_term", "duration",
        "months", "period", "repayment_period",
    ],
    "purpose": [
        "purpose", "loan_purpose", "product", "product_type", "loan_type",
        "facility_type", "category", "use_of_funds",
    ],
    "address": [
        "address", "residential_address", "home_address", "location",
        "village", "parish", "district", "region",
    ],
    "latitude": ["latitude", "lat", "gps_lat", "y_coordinate", "geo_lat"],
    "longitude": [
        "longitude", "lon", "long", "lng", "gps_lon", "gps_long",
        "x_coordinate", "geo_lon", "geo_long",
    ],
}

# The short name list of the browser page that only asks whether a header contains a known name.
PAGE_NAMES = {
    "loan_id": ["loan_id", "loanid", "loan_no", "id", "ref_no"],
    "borrower_id": ["borrower_id", "member_id", "client_id", "account_no"],
    "borrower_name": ["borrower_name", "name", "full_name", "member_name"],
    "phone": ["phone", "mobile", "telephone", "contact"],
    "amount": ["amount", "loan_amount", "principal"],
    "loan_date": ["loan_date", "date", "disbursement_date"],
    "approval_time": ["approval_time", "time", "timestamp"],
    "officer_id": ["officer_id", "staff_id", "approved_by"],
    "branch": ["branch", "location", "office"],
    "status": ["status", "loan_status", "state"],
}

# Content patterns per kind, any of which may match a trimmed value; kinds in tie order.
CONTENT_PATTERNS = {
    "phone": [r"^\+?256\d{9}$", r"^0\d{9}$", r"^\+?\d{10,15}$", r"^07\d{8}$", r"^256\d{9}$"],
    "national_id": [r"^[A-Z]{2}\d{13}[A-Z0-9]$", r"^CF\d{13}[A-Z]$", r"^CM\d{13}[A-Z]$", r"^\d{14}$"],
    "date": [r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}-\d{2}-\d{4}$", r"^\d{4}/\d{2}/\d{2}$"],
    "time": [r"^\d{2}:\d{2}(:\d{2})?$"],
    "amount": [r"^\d{1,3}(,\d{3})*(\.\d{2})?$", r"^\d+\.?\d*$"],
    "email": [r"^[\w\.-]+@[\w\.-]+\.\w+$"],
}
PATTERN_FIELDS = {
    "phone": "phone",
    "national_id": "national_id",
    "date": "loan_date",
    "time": "approval_time",
    "amount": "amount",
    "email": "email",
}

# Engine content patterns and the confidence of the field each one means, in test order.
ENGINE_PATTERNS = {
    "phone": (r"^(\+?256|0)?[0-9]{9}$", "phone", 90),
    "nin": (r"^[A-Z]{2}\d{13}[A-Z0-9]$", "national_id", 92),
    "date": (r"^\d{4}-\d{2}-\d{2}$|^\d{2}/\d{2}/\d{4}$", "loan_date", 85),
    "time": (r"^\d{2}:\d{2}(:\d{2})?$", "approval_time", 80),
    "commas": (r"^\d{1,3}(,\d{3})+(\.\d{2})?$", "amount", 85),
}

# Words that mark a status column; the engines know fewer.
STATUS_WORDS = [
    "active", "inactive", "paid", "closed", "pending", "approved",
    "rejected", "defaulted", "written_off", "disbursed", "completed", "overdue",
]
ENGINE_STATUS_WORDS = [
    "active", "inactive", "paid", "closed", "pending", "approved",
    "rejected", "defaulted", "completed", "disbursed", "overdue",
]

# Status spellings of known exports, for books that do not write the words out.
STATUS_CODES = {"a": "active", "c": "completed", "d": "defaulted", "p": "paid"}

# What each standard field means, in the words that headers are compared with.
FIELD_MEANINGS = {
    "loan_id": "loan identifier reference number contract id transaction",
    "borrower_id": "borrower member client customer account identifier number",
    "borrower_name": "borrower member client customer full name person applicant",
    "phone": "phone mobile telephone contact number cell calling",
    "national_id": "national id identification government id nin passport",
    "amount": "loan amount principal money value disbursed sum total",
    "loan_date": "loan date disbursement issue created application start",
    "disbursement_date": "disbursement date payout release funds transfer",
    "approval_time": "approval time timestamp created datetime hour minute",
    "officer_id": "officer staff employee agent user approved by identifier",
    "officer_name": "officer staff employee agent name loan processor",
    "branch": "branch office location center unit regional area",
    "status": "status state condition current active completed paid defaulted",
    "guarantor_name": "guarantor witness referee reference co-applicant name",
    "guarantor_phone": "guarantor witness referee phone mobile contact",
    "repayment_amount": "repayment installment payment monthly emi periodic",
    "interest_rate": "interest rate percentage annual monthly",
    "term_months": "term months duration tenure period loan length",
    "purpose": "purpose product type loan category facility use of funds",
    "address": "address location residential home village district region",
    "latitude": "latitude lat gps coordinate north south location",
    "longitude": "longitude long lng gps coordinate east west location",
}
# Fixed value: cosine from which a header means a field.
SEMANTIC_MINIMUM = 0.55
