"""Fixed values of the extraction contract: word lists, patterns, caps and thresholds.

Everything here is data. The values decide results, so they are kept together and in natural order.
"""

# --- fixed values: hosts whose sub-pages never contribute a homepage -------------------------
DENY_HOSTS = (
    "www.tripadvisor.com",
    "www.linkedin.com",
    "www.facebook.com",
    "www.investopedia.com",
    "www.eventbrite.com",
    "www.zoominfo.com",
    "twitter.com",
    "www.zillow.com",
    "www.nejm.org",
    "www.nytimes.com",
    "www.bizjournals.com",
    "www.telegram.com",
    "podcasts.apple.com",
    "www.youtube.com",
    "www.salary.com",
    "app.joinhandshake.com",
    "www.glassdoor.com",
    "finance.yahoo.com",
    "www.foxnews.com",
    "www.abcnews.go.com",
    "www.cbsnews.com",
    "www.instagram.com",
    "www.guidestar.org",
    "goo.gl",
    "m.facebook.com",
    "www.boostmobile.com",
    "order.online",
)

# --- fixed values: anchor texts of the two-level classifier: (label, text) --------------------
TYPE_ANCHORS = (
    ("Organization", 'Organization: A legal entity that has its own distinct mission, governance, and operational activities, and which is capable of entering into contracts, acquiring and disposing of assets, and engaging in other activities related to producing and distributing goods and services.'),
    ("Resource", 'Resource: Any physical or intangible asset that is used to produce or provide value in an economic network. In a modern economy, these can include access to capital, labor, knowledge, and technology.'),
)

SUBTYPE_ANCHORS = (
    ("Fiscal Resources", 'Fiscal resources financial resources governments banks private investment funds tax credits grants, subsidies, seed funding, equity, loans,Angel Investment, Award, Debt Relief, Fellowship, Financial Support, Forgivable Loans, Funding, Fundraising, Grant Funding, Grantmaking, Incentive or Subsidy, Income Tax Help, Incubator, Installment Loans, Intermediary Fund, LIHTC, Loans or Lending, Matching Funds, Microgrants, financial assistance support economic activity'),
    ("Information", 'Information resources provide access to knowledge data sources of information, libraries, archives, databases, online resources, research, reports, statistics, research projects, Business Directory, Business Support Tools, Classes, Collaboration Tools, Digital Resources, Digital Tool, Education, Evaluation Tool, Forums, Free Legal Aid, Guidance Documents, Informational Tool, Job Board, Language Immersion Classes, Media Source, Network, Networking, News, News Outlet, Blog, Newsletters, Newspapers, Office Hours, Podcast or Video, Research, Resource Guide, Roundtable, Seminar, Social Network, Speaker Series, Telehealth Resources, Tools, Tours, Training and Guides, Webinars'),
    ("Places", 'Places and venues physical locations where economic activities take place, factories, offices, stores, facilities, Annual Meeting, Art Exhibition, Circus, Co-working, Computer Lab, Concerts, Conference, Conference Rooms, Cultural Center, Dedicated Space, Demo Day, Event, Event Booth, Event Calendar, Events and Networks, Exhibition Space, Fabrication Space, Farmers Market, Festival, Forums, Gallery, Gathering Space, Hackathon, In-Person Workshop, Invitational, Job Fair, Kitchen Space, Lab Space, Large Event, Lounge, Makerspace, Marketplace, Meetup, Network, Networking, Office Hours, Office Space, Performance Space, Popup, Private Offices, Private Space, Production Space, Rehearsal Space, Retail Space, Roundtable, Safe places, Seminar, Shared Space, Shelter Resources, Showcase, Site Location, Site or Office Listings, Small Event, Social Network, Space, Speaker Series, Startup Studio, Studio Space, Summit or Conference, Temporary Shelter, Tours, Trade Show, Venues & Event Spaces, Virtual Community, Wet Lab, Workshop, Workshop Series'),
    ("Community Resources", 'Community resources communities or groups of individuals natural resources, cultural resources Affordable Housing, Aid, Care, Civic Engagement, Community Organizing, Computer Lab, Concerts, Cultural Center, Disability Services, Ecosystem Building, Education, Emergency Housing, Family Planning, Farmers Market, Free Legal Aid, Healthcare Access, Helpline, HOME Funds, Home Visiting, Housing Relief Services, Housing Services, Infant Care, LIHTC, Marketplace, Multi-family Home, Natural Disaster Relief, Neighborhood Revitalization, Outpatient Treatment, Popup, Public Housing, Rehabilitation, Relief Supplies, Reproductive Healthcare Services, Residential Care, Safe places, Section 8 HCV, Section 202, Section 515, Senior Care, Shelter Resources, Single Family Home, Sleep Wellness, Social Services, Strong Starts for Children, Sustainable Forestry, Telehealth Resources, Temporary Shelter, United Way Programming, Volunteer, Voucher'),
    ("Goods and Services", 'Goods and services: products and services that are traded in the market. They include tangible goods such as food, clothing, and electronics, as well as intangible goods such as consultation, healthcare, and entertainment, commodities, microservices, private profit, capitalization, market value, marketing, advertising, consultation services, professional services'),
    ("Development Programs", 'Development programs initiatives enhance skills, knowledge, and capabilities of individuals and businesses, professional development programs for individuals, business development programs support growth success of companies: job training, leadership development, mentorship, Accelerator, Accreditation Program, Ambassador Program, Apprenticeship Program, Artist Statement Development, Bootcamp, Business Support Tools, Certificate Program, Certifications, Classes, Cohort Style, Cohort-Based, Competition, Courses, Degree Program, Early Head Start, Education, Educational Program, Fellowship, Group Mentorship, Hackathon, In-Person Workshop, In-School Program, Incubator, Intensive, Internship Program, Language Immersion Classes, Mentorship, Online Course, Online Workshops, Permits and Licenses, Pitch Competition, Placement Program, Programs, Restorative Justice Programming, Scholarship, Seminar, Skill Development, Speaker Series, Sponsorship, Startup Studio, Structured Programs, Training and Guides, Webinars, Workforce Development, Workforce Training'),
)

# --- fixed values: match patterns (valid in Java and in RE2 alike) -----------------------------
EMAIL = r"[a-zA-Z0-9.+_-]+@[a-zA-Z0-9.+_-]+\.[a-zA-Z]*\.?[a-zA-Z]*"
PHONE = r"(\d{3}[-\.\s]??\d{3}[-\.\s]??\d{4}|\(\d{3}\)\s*\d{3}[-\.\s]??\d{4}|\d{3}[-\.\s]??\d{4})"
PRIORITY_PATH = r"^/(contact|about|our|resource|program)"

# --- fixed values: caps, gates and thresholds ---------------------------------------------------
KNOWN_URL_CAP = 100        # links kept from the one-hop visit of a homepage
MIN_SITE_LINKS = 2         # a one-hop result must rank more links than this
SITEMAP_CAP = 29           # sitemap entries kept per homepage
SITE_TEXT_MIN = 20         # site texts of at most this length fail
SITE_TEXT_LONG = 10000     # site texts from this length on are cut ...
SITE_TEXT_CUT = 9999       # ... to this length
RECORD_TEXT_MIN = 10       # texts of at most this length give no record
SUMMARY_LONG = 17000       # summary inputs above this length are cut ...
SUMMARY_CUT = 16900        # ... to this length
SHORT_SENTENCES = 2
LONG_SENTENCES = 5
EMPTY_SUMMARY = "re-extract me!"
NO_PARAMETERS = "insufficient kwargs"
HOUSE_THRESHOLD = 0.675    # single-vocabulary records
DUAL_HOUSE_THRESHOLD = 0.65
DUAL_PARADIGM_THRESHOLD = 0.55
LOCATION_TAG = "LOC"
