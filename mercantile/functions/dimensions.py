"""Business constants: segment names, rates, bands and tiers.

All values in this file are fixed values; results depend on each of them.
"""

from __future__ import annotations

# Labels that mean the same segment.
SEGMENT_ALIASES = {"Potential Loyalists": "Potential Loyalist"}

# Segment -> marketing audience.
MARKETING_AUDIENCE = {
    "Champions": "champions",
    "Loyal Customers": "loyal_customers",
    "Potential Loyalist": "potential_loyalists",
    "New Customers": "new_customers",
    "Need Attention": "need_attention",
    "At Risk": "at_risk",
    "Hibernating": "hibernating",
    "Lost": "lost",
    "Lost High Value": "lost",
}

# Segment -> base churn risk.
BASE_RISK = {
    "Champions": 0.05,
    "Loyal Customers": 0.10,
    "Potential Loyalist": 0.20,
    "New Customers": 0.30,
    "At Risk": 0.60,
    "Cant Lose Them": 0.80,
    "Lost": 0.95,
}
DEFAULT_RISK = 0.5

# Segment -> share of reached customers who buy.
CONVERSION_RATE = {
    "Champions": 0.15,
    "Loyal Customers": 0.12,
    "Potential Loyalist": 0.08,
    "New Customers": 0.10,
    "At Risk": 0.05,
    "Cant Lose Them": 0.03,
    "Lost": 0.02,
}
DEFAULT_CONVERSION = 0.05

# Channel -> share of a segment that a campaign reaches.
CHANNEL_REACH = {"email": 0.85, "sms": 0.95, "push": 0.70, "social": 0.60}
DEFAULT_REACH = 0.7

# Segment -> recommended action.
RECOMMENDED_ACTION = {
    "Champions": "Reward program, VIP treatment, early access to new products",
    "Loyal Customers": "Cross-sell premium products, loyalty rewards",
    "Potential Loyalist": "Personalized recommendations, engage with brand",
    "New Customers": "Onboarding sequence, welcome discounts, product education",
    "At Risk": "Win-back campaign, personalized offers, satisfaction survey",
    "Cant Lose Them": "Urgent retention offer, exclusive discount, direct outreach",
    "Lost": "Reactivation campaign, deep discount, feedback request",
}
DEFAULT_ACTION = "General nurturing"

# Upper bounds (exclusive) of the churn score -> segment; the last band is open.
SCORE_BANDS = [
    (0.1, "Champions"),
    (0.2, "Loyal Customers"),
    (0.35, "Potential Loyalist"),
    (0.5, "New Customers"),
    (0.7, "At Risk"),
    (0.85, "Cant Lose Them"),
]
LAST_SCORE_BAND = "Lost"

# Upper bounds (inclusive) of the model probability -> risk level.
RISK_LEVELS = [(0.2, "Low"), (0.4, "Medium"), (0.6, "High"), (1.0, "Critical")]

# Upper bounds (inclusive) of the lifetime value -> segment; the last bin is open.
LTV_LEVELS = [(100.0, "Low"), (500.0, "Medium"), (1000.0, "High")]
LAST_LTV_LEVEL = "Premium"

# Lower bounds of the risk filter.
HIGH_RISK = 0.6
MEDIUM_RISK = 0.3

# Share of churned customers won back, and cost per customer won back.
RETENTION_SCENARIOS = [
    ("Conservative", 0.05),
    ("Moderate", 0.10),
    ("Aggressive", 0.20),
    ("Targeted", 0.30),
]
RETENTION_COST = 25

# Tier -> calls per month (None: unlimited) and largest page.
TIER_CALLS = {"starter": 100, "growth": 10000, "enterprise": None}
TIER_PAGE = {"starter": 10}

# Segments that count as churned when only segment labels exist, with stand-in features.
CHURNED_SEGMENTS = ["Hibernating", "Lost High Value", "Lost Low Value"]
FALLBACK_REVIEW = 4.0
FALLBACK_LATE_RATE = 0.1

# Text searched in segment labels -> (audience, action, priority).
RECOMMENDATION_RULES = [
    ("Champion", "Champions", "VIP treatment - exclusive offers, early access to products", "HIGH"),
    ("Risk", "At Risk Customers", "Win-back campaigns with special discounts", "HIGH"),
    ("New", "New Customers", "Onboarding sequences, first-purchase incentives", "MEDIUM"),
    ("Hibernat", "Hibernating", "Re-engagement campaigns with time-limited offers", "MEDIUM"),
]
CHURN_RECOMMENDATION = (
    "Churned Revenue",
    "Implement retention programs - loyalty rewards, personalized outreach",
    "CRITICAL",
)
CHURN_ALERT_PCT = 50.0
