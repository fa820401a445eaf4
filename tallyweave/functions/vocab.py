"""Vocabularies, word lists and patterns that results depend on."""

# Fixed values.
DOCUMENT_STATUS = ["discovered", "fetched", "classified", "extracted", "validated", "resolved", "ready_for_review", "published", "failed", "excluded", "superseded_document"]
RELATION_TYPES = ["customer", "supplier", "lender", "subsidiary", "parent", "group_company", "unnamed_dependency"]
NODE_TYPES = ["target", "customer", "supplier", "lender", "subsidiary", "parent", "group_company", "unnamed_dependency", "industry"]
RISK_FLAGS = ["high", "medium", "low"]
RETAINED_TIERS = ["human_verified", "machine_validated"]
VERIFICATION_TIERS = ["human_verified", "machine_validated", "excluded"]
LIFECYCLE_STATES = ["current", "aging", "superseded", "not_restated"]
REVIEW_STATES = ["pending", "needs_second_look", "decided"]
DECISION_METHODS = ["individual", "bulk"]
CONFIDENCES = ["high", "medium"]
AGENCIES = ["CRISIL", "ICRA", "CARE", "India Ratings"]
MISMATCH_BUCKETS = ["table_derived", "cross_page", "truncated", "paraphrase", "not_found"]
STATUS_CHAIN = ["discovered", "fetched", "classified", "extracted", "validated", "resolved", "ready_for_review", "published"]
STATUS_ENDS = ["failed", "excluded", "superseded_document"]
LEGAL_SUFFIXES = ["limited", "ltd", "private", "pvt", "plc", "inc", "incorporated", "corporation", "corp", "company", "co", "llp", "llc", "gmbh", "sa", "nv", "bv", "ag", "pte"]
RATIONALE_HEADINGS = ["key rating drivers", "list of key rating drivers", "detailed description of key rating drivers", "detailed rationale of the rating action", "analytical approach", "credit strengths", "credit challenges", "liquidity position", "liquidity", "rating sensitivities", "about the company", "key financial indicators", "rating history", "bank wise facilities details"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
GOVERNMENT = r"(?i)^(ministry of defence|government of india|indian (army|navy|air force|airforce)|indian space research organisation|isro|indian railways)$"
FOREIGN = r"(?i)\b(bloom energy|motorola mobility|ismartu|longcheer|toshiba|samsung|lg|xiaomi|rolls[- ]royce|dassault|israel aerospace|blue origin)\b"
LENDING_INSTITUTION = r"(?i)\b(bank|lic|life insurance corporation)\b"
RATING_LANGUAGE = r"(?i)\b(credit\s*rating|rating\s*action|rating\s*agency|crisil|icra|care\s*ratings?|india\s*ratings?|ind[- ]?ra|acuite|brickwork|infomerics)\b"
SUBSTANCE = r"revenue|turnover|operat|manufactur|supply|customer|support|guarantee|obligation|debt|loan|funding|cash flow|financial"
PHRASES = [r"(?i)\bassociate company\b", r"(?i)\bjoint venture\b", r"(?i)\b(?:acquisition of (?:a )?majority stake|acquir(?:ed|es|ing)? (?:a )?majority stake|majority stake acquisition)\b"]
RATIONALE_LABEL = r"(?i)\b(rating rationale|credit rationale|rationale report|rating\s+report)\b"
RATING_INTIMATION = r"(?i)\b(rating intimation|rating action|rating reaffirmed|credit rating(?:s)?\s+(?:assigned|reaffirmed|revised|upgraded|downgraded|affirmed))\b|\b(?:has|have)\s+(?:assigned|reaffirmed|revised|upgraded|downgraded|affirmed)\b[\s\S]{0,140}\brating\b"
ANNUAL_REPORT = r"(?i)\bannual report\b"
RELATED_PARTY = r"(?i)\brelated party transaction|rpt schedule\b"
ORDER = r"(?i)\b(?:order win|order received|letter of award)\b"
DRHP = r"(?i)\b(?:draft red herring prospectus|drhp)\b"
TRANSCRIPT = r"(?i)\b(?:earnings|investor|results)\s+(?:call|conference call|transcript)\b|\b(?:analyst|participant)\s+(?:q&a|questions?)\b"
TABLE_HEADER = r"(?i)\b(annexure|list|details|facility|facilities|amount|limit|lender|rating|consolidation|sr|no)\b"
SEEN_BY_TARGET = {
    "customer": "Supplies to %s",
    "supplier": "Receives supplies from %s",
    "lender": "Financed by %s",
    "subsidiary": "Operates through subsidiary %s",
    "parent": "Part of %s",
    "group_company": "Group relationship with %s",
    "unnamed_dependency": "Has a reported unnamed dependency",
}
SEEN_BY_OTHERS = {
    "customer": "Customer of %s",
    "supplier": "Supplies to %s",
    "lender": "Lender to %s",
    "subsidiary": "Subsidiary of %s",
    "parent": "Parent of %s",
    "group_company": "Group company of %s",
    "unnamed_dependency": "Reported unnamed dependency of %s",
    "industry": "Industry relationship with %s",
}
NO_RATING = "Rating not stated"
NO_REPORT_DATE = "report date not stated"
FEED_KEYS = {
    "external_id": ["NEWSID", "NEWS_ID", "ANNOUNCEMENT_ID", "ID"],
    "scrip_code": ["SCRIP_CD", "SCRIPCODE", "SCRIP_CODE"],
    "company_name": ["SLONGNAME", "SCRIP_NAME", "COMPANYNAME", "COMPANY_NAME"],
    "headline": ["NEWSSUB", "HEADLINE", "SUBJECT", "NEWS_SUBJECT"],
    "category": ["CATEGORYNAME", "CATEGORY", "NEWS_CATEGORY"],
    "sub_category": ["SUBCATNAME", "SUBCATEGORY", "SUB_CATEGORY"],
    "date": ["DissemDT", "ANNOUNCEMENT_DATE", "NEWS_DT", "NEWS_DATE", "DT_TM"],
    "attachment": ["ATTACHMENTURL", "ATTACHMENT_URL", "ATTACHMENTNAME", "ATTACHMENT"],
}
HOST_SOURCES = [("crisil", "crisil"), ("icra", "icra"), ("care", "care"), ("indiaratings", "india_ratings"), ("india-ratings", "india_ratings"), ("ind-ra", "india_ratings"), ("bseindia", "bse"), ("nseindia", "nse")]
FEED_SITE = "https://www.bseindia.com"
RETRYABLE_CODES = ["ECONNRESET", "ETIMEDOUT", "ENOTFOUND", "ECONNREFUSED", "EPIPE", "UND_ERR_SOCKET"]
PAGE_KEYWORDS = r"(?i)customer|supplier|vendor|procurement|import|raw material|concentration|counterparty"
STRUCTURE_TYPES = ["subsidiary", "group_company"]
DEPENDENCY_TYPES = ["customer", "supplier", "lender"]
