"""Hand-written clauses and names that the text queries run over, the same rows in both engines."""

from __future__ import annotations

CLAUSES = [
    "We never sell your data to any third party.",
    "In no event shall your name be traded.",
    "We may share aggregate statistics with our partners.",
    "You must not disclose your password to others.",
    "Children under 13 may not register; COPPA applies.",
    "We do not knowingly collect information from children.",
    "You have the right to access and delete your data.",
    "Consumer rights include the right to opt out.",
    "The following categories of personal information are collected.",
    "This privacy policy describes what we do.",
    "Our lawful basis is legitimate interest or consent.",
    "We will delete your account data within 30 days.",
    "We retain logs for up to 12 months.",
    "Reports do not include any personal data.",
    "Personal information means information that identifies you.",
    "How do we protect your data?",
    "With your consent we share your location.",
    "If you opt in, we send offers.",
    "We share data unless you opt out.",
    "We disclose data when required by law.",
    "Cookies are set automatically.",
    "We must keep invoices.",
    "We might ask for your age.",
    "Usually we answer within a week.",
    "We use encryption and security measures to protect all data.",
    "Contact our data protection officer at any time.",
    "You may lodge a complaint with the supervisory authority.",
    "Data is transferred under standard contractual clauses.",
    "We obtained from brokers some of your interests.",
    "We use profiling to predict user interests.",
    "You can withdraw consent or unsubscribe.",
    "We only use your email for security.",
    "Data is kept as long as necessary.",
    "To access Maps we do not share your account data.",
    "We do not store cards but use a processor.",
    "We do not sell data unless you agree.",
    "Our VPN Pro product does not log.",
    "Make a donation with PayPal or by credit card information.",
    "Sign up for our newsletter to enter the contest.",
    "California residents: see the CCPA notice.",
    "EU residents are covered by GDPR.",
    "Business customers sign a data processing agreement.",
    "Publicly available profile data may be used.",
    "Other users see your name when you collaborate with other users.",
    "We generally will not share data with law enforcement.",
    "Your telecom operator sees your number.",
    "Student data is covered by FERPA.",
    "Subject to their own privacy rules.",
    "Password fields are excluded from recordings: password field.",
    "Données personnelles: nous ne vendons rien.",
    "retention",
    "Sale",
    "",
    "We keep it 2.5 years, then 3 weeks more.",
    "We do not require your consent for this.",
    "We process personal data in this context only if you agree.",
    "Full stop: it is never shared.",
    "Legal obligation: we verify identities.",
    "We sell the sale proceeds of old servers.",
    "ALL CAPS NOTICE ABOUT MINORS",
]
TERMS = [
    "Email Address", "e-mail address", "your email", "IP addresses", "ip_address", "cookies", "precise location", "GPS", "your full name and title", "phone numbers", "browsing histroy", "pyment information",
    "information about your device identifiers", "credit card number", "shoe size", "personal information", "search query", "Health Data!", "photos", "usernames", "date  of  birth", "purchase history of users", "", "mobile advertising id", "social security number", "race",
]
AIMS = ["analytics", "Targeted ads", "improve our services", "to prevent fraud", "legal", "marketing emails", "personalisation", "security purposes", "astrology", "service delivery", "authenticate you", "reserch", "advertising", ""]
DURATIONS = ["30 days", "2.5 years", "6 Months or 1 year", "as long as needed", "", "12 hours", "3 weeks", "1 day", "day 3", "90days"]

POLICIES = [
    ("site", "# Privacy Policy of Example\nLast updated: May 2, 2024\n\n1. What We Collect\nWe collect the following kinds of data from you:\n- your email address and your full name\n- the address of your device on the network\n\nDATA SHARING\nWe share your email address with our partners, but we do not sell your phone number to anyone.\nThis sentence goes on in the next line.\n\nYour choices:\n* You can ask us to delete everything at any time\nshort\n"),
    ("vendor", "Retention\n\nWe keep the data of visitors as long as it takes:\n\n" + "We use your browsing history for analytics. " * 60 + "\n\nJanuary 3, 2023\na) bullets with letters are also found here\n"),
    ("empty", ""),
]
