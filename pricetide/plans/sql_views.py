"""The sample views once more, in SQL, for checking the registered queries."""

VIEWS = r"""
ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         'https://www.amazon.fr/dp/U' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '/' AS url
  FROM events
),
items_log AS (
  SELECT url,
         CASE WHEN k = 0 THEN '' WHEN k < 99 THEN 'Product ' || user_id END AS title,
         CASE WHEN event_type <> 'error' THEN value END AS price,
         CASE WHEN event_type = 'purchase' THEN value * 1.25 END AS crossed,
         CASE WHEN event_type = 'view' THEN value / 3 END AS unit_price,
         CASE WHEN event_type = 'click' THEN 'in ' || (k % 5) || ' days' END AS delivery,
         'https://img.example/images/I/u' || user_id || '._AC_US40_.jpg' AS image,
         CASE WHEN k % 10 <> 9 THEN 'kw' || (k % 7) END AS keyword,
         ts AS scraped_at, event_id AS seq, CAST(ts AS DATE) AS day
  FROM ev
),
items AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY url, day ORDER BY scraped_at DESC, seq DESC) AS rn FROM items_log
  ) WHERE rn = 1
),
as_of AS (SELECT max(ts) AS now FROM events),
windows AS (
  SELECT url, day, price,
         sum(floor(price * 16777216) / 16777216) OVER month AS coarse, sum(price - floor(price * 16777216) / 16777216) OVER month AS rest,
         count(price) OVER month AS priced, row_number() OVER (PARTITION BY url ORDER BY day) - 1 AS observations
  FROM items
  WINDOW month AS (PARTITION BY url ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)
),
features AS (
  SELECT url, day, price, observations, (coarse + rest) / nullif(priced, 0) AS mean_30d FROM windows WHERE price IS NOT NULL
),
newest_features AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY day DESC) AS rn FROM features) WHERE rn = 1
),
trends AS (
  SELECT url, CASE WHEN relative <= -0.5 THEN 'down' WHEN relative >= 0.5 THEN 'up' ELSE 'stable' END AS trend FROM (
    SELECT url, regr_slope(price, CAST(day - DATE '2024-01-01' AS DOUBLE)) / nullif(avg(price), 0) * 100 AS relative
    FROM features GROUP BY url)
),
scores AS (
  SELECT url, CAST(printf('%.1f', (mean_30d - price) / mean_30d * 100) AS DOUBLE) AS score,
         CAST(printf('%.2f', mean_30d) AS DOUBLE) AS predicted_price, price AS actual_price, 'EUR' AS currency, trend
  FROM newest_features JOIN trends USING (url), as_of
  WHERE observations >= 5 AND mean_30d IS NOT NULL AND CAST(day AS TIMESTAMP) >= now - INTERVAL 48 HOUR
),
newest AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY day DESC, scraped_at DESC) AS rn FROM items) WHERE rn = 1
),
newest_keyworded AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY day DESC, scraped_at DESC) AS rn FROM items WHERE keyword IS NOT NULL
  ) WHERE rn = 1 AND price IS NOT NULL AND (title IS NULL OR title <> '')
),
newest_per_keyword AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY keyword, url ORDER BY day DESC, scraped_at DESC) AS rn FROM items WHERE keyword IS NOT NULL
  ) WHERE rn = 1 AND price IS NOT NULL AND (title IS NULL OR title <> '')
),
scored AS (
  SELECT p.*, s.score, s.predicted_price, s.trend, coalesce(s.score, -1) >= 10 AS is_deal, coalesce(s.score, -1) AS sort_score,
         CASE WHEN crossed > 0 AND price > 0 THEN 1 - price / crossed ELSE 0 END AS discount_ratio
  FROM newest_per_keyword p LEFT JOIN scores s USING (url)
),
histories AS (
  SELECT i.url, n.keyword, n.title, n.image, min(i.day) AS first_seen, max(i.day) AS last_seen, count(*) AS entries
  FROM items i JOIN newest n USING (url) GROUP BY ALL
),
keywords AS (
  SELECT DISTINCT keyword, CASE WHEN keyword <> 'kw5' THEN CAST(keyword[3] AS INTEGER) % 3 <> 0 END AS enabled
  FROM items_log WHERE keyword IS NOT NULL
  UNION ALL SELECT 'kw_unseen', TRUE
),
tracked_urls AS (
  SELECT 'https://www.amazon.fr/dp/U' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '/' AS url,
         CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal > 0 END AS enabled
  FROM customer
),
favorites AS (
  SELECT 'https://www.amazon.fr/dp/U' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '/' AS url, min(CAST(o_orderdate AS TIMESTAMP)) AS added_at
  FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey
),
keyword_stats AS (
  SELECT keyword, count(DISTINCT url) AS product_count, max(scraped_at) AS last_scrape FROM items
  WHERE keyword IS NOT NULL AND price IS NOT NULL AND (title IS NULL OR title <> '') GROUP BY keyword
),
deal_rows AS (
  SELECT n.*, s.score, s.predicted_price, s.trend FROM newest_keyworded n JOIN scores s USING (url) WHERE s.score >= 10
),
supplier_items AS (
  SELECT url, day, price FROM (
    SELECT 'supplier/' || l_suppkey AS url, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS price,
           row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn
    FROM lineitem) WHERE rn = 1
),
fetch_log AS (
  SELECT url, CASE WHEN k % 20 = 3 THEN 'https://www.amazon.fr/' WHEN k % 20 = 7 THEN 'https://www.amazon.fr/errors/validateCaptcha?x=1'
                   ELSE url || '?th=1' END AS final_url, event_id AS seq FROM ev
),
keyword_commands AS (
  SELECT CASE WHEN k = 50 THEN NULL WHEN k >= 90 THEN 'kw_new' || (k % 13) ELSE 'kw' || (k % 7) END AS key,
         CASE event_type WHEN 'signup' THEN 'track' WHEN 'error' THEN 'untrack' END AS action, ts, event_id AS seq
  FROM ev WHERE event_type IN ('signup', 'error')
),
url_commands AS (
  SELECT CASE WHEN event_type = 'click' AND k % 10 = 7 THEN NULL WHEN event_type = 'purchase' AND k = 33 THEN NULL ELSE url END AS key,
         CASE event_type WHEN 'click' THEN 'track' WHEN 'purchase' THEN 'untrack' END AS action, ts, event_id AS seq
  FROM ev WHERE event_type IN ('click', 'purchase')
),
favorite_commands AS (
  SELECT CASE WHEN k = 44 THEN NULL WHEN k = 45 AND event_type = 'view' THEN NULL
              WHEN k = 45 THEN 'https://www.amazon.de/dp/B000000000' ELSE url END AS key, k,
         CASE event_type WHEN 'view' THEN 'add' ELSE 'remove' END AS action, ts, event_id AS seq
  FROM ev WHERE event_type = 'view' OR (event_type = 'error' AND k % 2 = 0)
)
"""

# Doubles summed in different orders differ in the last digits, so they are compared as whole numbers of
# millionths. The odd offset keeps the steps away from values that decimal prices can average to.
OFFSET = 0.3137


def millionths(expression: str) -> str:
    return f"CAST(floor(({expression}) * 1000000 + {OFFSET}) AS DOUBLE)"


ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"


def outcomes_sql(commands: str, state: str, key: str) -> str:
    """Outcome of each tracking command, read off the whole ordered log of its key."""
    return f"""
      SELECT seq, key, action,
             CASE WHEN key IS NULL THEN 'invalid'
                  WHEN action = 'untrack' AND NOT known THEN 'not_found'
                  WHEN action = 'untrack' THEN 'untracked'
                  WHEN NOT known THEN 'created'
                  WHEN before = 'track' OR (before IS NULL AND coalesce(enabled, TRUE)) THEN 'conflict'
                  ELSE 'reenabled' END AS outcome
      FROM (
        SELECT c.*, s.enabled,
               lag(action) OVER w AS before,
               s.{key} IS NOT NULL OR coalesce(max(CASE WHEN action = 'track' THEN 1 ELSE 0 END)
                 OVER (PARTITION BY c.key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS known
        FROM {commands} c LEFT JOIN {state} s ON c.key = s.{key}
        WINDOW w AS (PARTITION BY c.key ORDER BY ts, seq))"""


def state_sql(commands: str, state: str, key: str) -> str:
    """State after the log: the last command that changed something decides."""
    return f"""
      WITH done AS ({outcomes_sql(commands, state, key)}),
      written AS (
        SELECT key, outcome, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM done
        WHERE outcome IN ('created', 'reenabled', 'untracked'))
      SELECT coalesce(s.{key}, w.key) AS key,
             CAST(CASE WHEN w.key IS NULL THEN s.enabled ELSE w.outcome <> 'untracked' END AS VARCHAR) AS enabled
      FROM {state} s FULL JOIN (SELECT * FROM written WHERE rn = 1) w ON s.{key} = w.key"""
