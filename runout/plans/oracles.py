"""DuckDB statements the registered queries are checked against, over the driver's tables.

They are written apart from the Spark code: typed staging relations come straight from the order
tables without the text step, working days are found by searching the day list, coverage is a
correlated sum and the projection a full day grid.
"""

from __future__ import annotations

import re

ANCHOR = "DATE '2000-01-03'"
END = "DATE '2000-05-02'"  # anchor + 120
SHOWN_MATERIAL = "000000000000000001-1001"

RELATIONS = {
    "line": f"""
        SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln,
               l_tax AS tax, l_returnflag AS rf, l_linestatus AS ls, l_extendedprice AS price,
               {ANCHOR} + CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 540
                               - 400 AS INTEGER) AS fd,
               CAST(1000 + (l_partkey + l_orderkey % 2) % 4 AS VARCHAR) AS plant,
               lpad(CAST(l_partkey AS VARCHAR), 18, '0') AS mat,
               lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS ven,
               CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) AS po,
               CAST(l_quantity AS DECIMAL(10,2)) AS q
        FROM lineitem""",
    "ordered": "SELECT * FROM line WHERE rf = 'N'",
    "shipped": f"""
        SELECT *, po || '/' || strftime(fd, '%Y%m%d') AS dn
        FROM ordered WHERE tax < 0.05 AND fd < {ANCHOR} + 60""",
    "spot": "SELECT DISTINCT pk, mat, plant FROM line WHERE pk % 40 <> 39",
    # -- typed staging relations
    "stg_t001w": """
        SELECT CAST(1000 + n_nationkey AS VARCHAR) AS plant,
               'Plant ' || CAST(1000 + n_nationkey AS VARCHAR) AS plant_name,
               lpad(CAST(n_nationkey % 3 + 1 AS VARCHAR), 2, '0') AS factory_calendar_key,
               '1000' AS purchasing_org, n_name AS country,
               'City ' || CAST(n_nationkey AS VARCHAR) AS city
        FROM nation""",
    "stg_tfact": """
        SELECT DISTINCT factory_calendar_key AS calendar_id, lang AS language,
               'Calendar ' || factory_calendar_key || ' ' || lang AS calendar_name
        FROM stg_t001w, (VALUES ('E'), ('D')) AS langs(lang)""",
    "stg_lfa1": """
        SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS vendor_id,
               lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS vendor_number,
               s_name AS vendor_name, n_name AS country,
               'City ' || CAST(s_suppkey % 7 AS VARCHAR) AS city,
               CAST(n_regionkey AS VARCHAR) AS region, DATE '1998-01-01' AS created_date,
               CASE WHEN s_acctbal < 0 THEN 'X' END AS payment_block_flag
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "stg_marc": """
        SELECT mat || '-' || plant AS marc_id, mat AS material_number, plant,
               'M' || CAST(pk % 5 AS VARCHAR) AS mrpc,
               CASE WHEN pk % 20 < 17 THEN 'F' WHEN pk % 20 < 19 THEN 'E' ELSE 'X' END
                   AS procurement_type,
               CAST(pk % 4 AS DECIMAL(10,2)) AS gr_processing_days,
               CAST(p_size AS DECIMAL(10,2)) AS safety_stock,
               CAST(2 * p_size AS DECIMAL(10,2)) AS reorder_point,
               CASE WHEN p_size <= 5 THEN 'A' WHEN p_size <= 15 THEN 'B' ELSE 'C' END
                   AS abc_indicator,
               CAST(5 + pk % 20 AS DECIMAL(10,2)) AS planned_delivery_days,
               'G' || CAST(pk % 3 AS VARCHAR) AS purchasing_group
        FROM spot JOIN part ON p_partkey = pk""",
    "stg_mard": """
        SELECT mat AS material_number, plant, place AS storage_location,
               CAST(factor * p_size AS DECIMAL(10,2)) AS unrestricted_stock,
               CAST(pk % 3 AS DECIMAL(10,2)) AS quality_inspection_stock,
               CAST(pk % 5 AS DECIMAL(10,2)) AS blocked_stock,
               CAST(0 AS DECIMAL(10,2)) AS transfer_stock
        FROM spot JOIN part ON p_partkey = pk,
             (VALUES ('0001', 2), ('0002', 1)) AS places(place, factor)
        WHERE pk % 25 <> 3""",
    "stg_equk": f"""
        SELECT mat AS material_number, plant, mat || '-' || plant AS quota_arrangement_number,
               {ANCHOR} - CAST(60 + pk % 340 AS INTEGER) AS valid_from,
               CASE WHEN pk % 10 = 9 THEN {ANCHOR} - 10
                    ELSE {ANCHOR} + CAST(60 + pk % 300 AS INTEGER) END AS valid_to,
               DATE '1999-01-01' AS created_date,
               CAST(0 AS DECIMAL(10,2)) AS total_released_quantity
        FROM spot WHERE pk % 20 < 17""",
    "stg_equp": """
        SELECT DISTINCT mat || '-' || plant AS quota_arrangement_number, ven AS quota_item,
               ven AS vendor_number, 'F' AS procurement_type,
               CAST(CASE WHEN pk % 30 = 1 THEN 0 ELSE 10 + sk % 50 END AS DECIMAL(10,2)) AS quota,
               CAST(0 AS DECIMAL(10,2)) AS quota_usage_quantity,
               CAST(sk % 30 AS DECIMAL(10,2)) AS planned_delivery_days
        FROM ordered""",
    "stg_vbak": """
        SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS sales_order_id,
               CAST(o_orderdate AS DATE) AS created_date, '120000' AS created_time,
               CAST(NULL AS VARCHAR) AS created_by, 'TA' AS sales_document_type,
               lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS customer_number,
               CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS net_value,
               'EUR' AS currency, CAST(NULL AS VARCHAR) AS sales_organization,
               CAST(NULL AS VARCHAR) AS distribution_channel, CAST(NULL AS VARCHAR) AS division,
               o_orderstatus AS delivery_status
        FROM orders""",
    "stg_vbap": """
        SELECT lpad(CAST(ok AS VARCHAR), 10, '0') AS sales_order_number,
               lpad(CAST(ln AS VARCHAR), 6, '0') AS sales_order_item, mat AS material_number,
               q AS order_quantity, 'EA' AS order_unit,
               CAST(q * 10 AS DECIMAL(10,2)) AS net_value, 'EUR' AS currency, plant,
               CAST(NULL AS VARCHAR) AS storage_location, CAST(NULL AS VARCHAR) AS item_category,
               CAST(NULL AS VARCHAR) AS rejection_reason, fd AS created_date
        FROM line""",
    "stg_resb": f"""
        SELECT CAST(ok AS VARCHAR) AS reservation_number, CAST(ln AS VARCHAR) AS reservation_item,
               ['M', 'F', 'N'][CAST(ln % 3 AS INTEGER) + 1] AS reservation_type,
               mat AS material_number, plant, CAST(NULL AS VARCHAR) AS storage_location,
               CAST(NULL AS VARCHAR) AS order_number, CAST(NULL AS VARCHAR) AS sales_order_number,
               fd AS requirement_date, q AS required_quantity,
               CAST(CASE WHEN fd < {ANCHOR} AND tax < 0.075 THEN q ELSE 0 END AS DECIMAL(10,2))
                   AS withdrawn_quantity,
               'EA' AS unit_of_measure, CAST(NULL AS VARCHAR) AS final_issue_flag
        FROM line WHERE rf = 'R'""",
    "stg_vbbe": f"""
        SELECT lpad(CAST(ok AS VARCHAR), 10, '0') AS sales_order_number,
               lpad(CAST(ln AS VARCHAR), 6, '0') AS sales_order_item, mat AS material_number,
               plant, ['KE', 'KEL', 'LSF', NULL][CAST(ln % 4 AS INTEGER) + 1] AS requirement_type,
               CAST(NULL AS VARCHAR) AS sales_document_type,
               CAST(NULL AS VARCHAR) AS customer_number, fd AS requirement_date,
               CAST(q AS DECIMAL(18,4)) AS open_requirement_qty,
               CAST(0 AS DECIMAL(18,4)) AS confirmed_qty, 'EA' AS unit_of_measure
        FROM line WHERE rf = 'A' AND (fd >= {ANCHOR} OR tax >= 0.075)""",
    "stg_ekko": """
        SELECT DISTINCT po AS po_number, ven AS vendor_number, '1000' AS purchasing_org,
               CAST(NULL AS VARCHAR) AS purchasing_group, 'LP' AS po_type,
               DATE '1999-01-01' AS po_date, 'EUR' AS currency,
               CASE WHEN ok % 50 = 0 THEN 'L' END AS deletion_flag,
               CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS incoterms_1,
               CAST(NULL AS VARCHAR) AS incoterms_2
        FROM ordered""",
    "stg_ekpo": """
        SELECT po || '-' || CAST(pk AS VARCHAR) AS ekpo_id, mat || '-' || plant AS marc_id,
               po AS po_number, CAST(pk AS VARCHAR) AS po_item, mat AS material_number, plant,
               CAST(NULL AS VARCHAR) AS material_group, CAST(SUM(q) AS DECIMAL(10,2))
                   AS order_quantity,
               'EA' AS unit_of_measure, CAST(10 + pk % 90 AS DECIMAL(10,2)) AS net_price,
               CAST(round(SUM(q) * (10 + pk % 90) * (CASE WHEN ok % 100 = 13 THEN 1.1 ELSE 1 END),
                          2) AS DECIMAL(10,2)) AS net_value,
               CAST(NULL AS VARCHAR) AS item_category,
               CASE WHEN pk % 50 = 7 THEN 'X' END AS deletion_flag,
               CAST(NULL AS VARCHAR) AS delivery_completed_flag
        FROM ordered GROUP BY po, ok, pk, mat, plant""",
    "stg_eket": f"""
        SELECT po || '-' || CAST(pk AS VARCHAR) AS ekpo_id, po AS po_number,
               CAST(pk AS VARCHAR) AS po_item, CAST(ln AS VARCHAR) AS schedule_line_number,
               CASE WHEN ok % 89 = 0 THEN {ANCHOR} - 800 ELSE fd END AS delivery_date,
               CASE WHEN ok % 89 = 0 THEN {ANCHOR} - 800 ELSE fd END AS goods_receipt_date,
               CASE WHEN ok % 89 = 0 THEN {ANCHOR} - 800 ELSE fd END AS planned_delivery_date,
               q AS scheduled_quantity, got AS goods_receipt_quantity, q - got AS open_quantity
        FROM (SELECT *, CAST(CASE WHEN fd >= {ANCHOR} THEN 0 WHEN ls = 'F' THEN q
                                  ELSE floor(q / 2) END AS DECIMAL(10,2)) AS got FROM ordered)""",
    "stg_likp": f"""
        SELECT dn AS delivery_number, 'EL' AS delivery_type,
               CAST(NULL AS VARCHAR) AS customer_number, CAST(NULL AS VARCHAR) AS sales_org,
               CAST(NULL AS VARCHAR) AS route, made AS created_date, fd AS planned_delivery_date,
               fd AS planned_goods_issue_date,
               CASE WHEN fd < {ANCHOR} THEN made END AS actual_goods_issue_date,
               CAST(0 AS DECIMAL(10,2)) AS net_value, CAST(NULL AS VARCHAR) AS currency
        FROM (SELECT DISTINCT dn, fd,
                     CASE WHEN ok % 97 = 0 THEN {ANCHOR} - 800
                          ELSE fd + CAST(sk % 7 - 4 AS INTEGER) END AS made
              FROM shipped)""",
    "stg_lips": """
        SELECT dn AS delivery_number, CAST(pk AS VARCHAR) AS delivery_item, mat AS material_number,
               CAST(NULL AS VARCHAR) AS material_group, plant,
               CAST(NULL AS VARCHAR) AS storage_location, po AS reference_document,
               CAST(pk AS VARCHAR) AS reference_item, '101' AS movement_type,
               fd AS goods_receipt_date, CAST(SUM(q) AS DECIMAL(10,2)) AS delivery_quantity,
               CAST(0 AS DECIMAL(10,2)) AS net_value, 'EA' AS unit_of_measure
        FROM shipped GROUP BY dn, pk, mat, plant, po, fd""",
    "stg_vbup": f"""
        SELECT DISTINCT dn AS document_number, CAST(pk AS VARCHAR) AS document_item,
               CAST(NULL AS VARCHAR) AS overall_status, CAST(NULL AS VARCHAR) AS delivery_block,
               CASE WHEN fd < {ANCHOR} AND sk % 10 < 8 THEN 'C' WHEN sk % 2 = 0 THEN 'A'
                    ELSE 'B' END AS goods_movement_status,
               CAST(NULL AS VARCHAR) AS billing_status, CAST(NULL AS VARCHAR) AS goods_issue_status,
               CAST(NULL AS VARCHAR) AS final_delivery_status,
               CAST(NULL AS VARCHAR) AS cost_status, CAST(NULL AS VARCHAR) AS credit_status
        FROM shipped WHERE sk % 17 <> 0""",
    "lane": """
        SELECT vendor_number AS lifnr, '1000' AS ekorg, plant AS werks,
               CAST(3 + CAST(substr(v.country, 8) AS INTEGER) % 5 * 6
                    + CASE plant WHEN '1001' THEN 1 WHEN '1002' THEN 2 WHEN '1003' THEN 1 ELSE 0 END
                    AS INTEGER) AS transit_time_days
        FROM stg_lfa1 v CROSS JOIN stg_t001w p""",
    # -- working days: the day list, and for every day the first working day not before it
    "days": f"""
        SELECT CAST(d AS DATE) AS day
        FROM generate_series({ANCHOR} - 750, {ANCHOR} + 200, INTERVAL 1 DAY) AS g(d)""",
    "workday": """
        SELECT day, row_number() OVER (ORDER BY day) AS n FROM days WHERE isodow(day) < 6""",
    "first_workday": """
        SELECT d.day, MIN(w.n) AS n FROM days d JOIN workday w ON w.day >= d.day GROUP BY d.day""",
    "calendar": """
        SELECT plant, factory_calendar_key, day AS calendar_date,
               CAST(isodow(day) < 6 AS INTEGER) AS is_workingday,
               day + CASE isodow(day) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS jump_to_wd_date,
               technical_day_number
        FROM stg_t001w CROSS JOIN (
            SELECT day, COUNT(CASE WHEN isodow(day) < 6 THEN 1 END) OVER (ORDER BY day)
                       AS technical_day_number
            FROM days) d""",
    # -- planning relations
    "stock": """
        SELECT m.*, COALESCE(s.free, 0) AS available_stock, COALESCE(s.blocked, 0)
                   AS blocked_stock_s, COALESCE(s.quality, 0) AS blocked_stock_q
        FROM stg_marc m LEFT JOIN (
            SELECT material_number || '-' || plant AS id, SUM(unrestricted_stock) AS free,
                   SUM(blocked_stock) AS blocked, SUM(quality_inspection_stock) AS quality
            FROM stg_mard GROUP BY ALL) s ON s.id = m.marc_id""",
    "quota": f"""
        SELECT h.quota_arrangement_number, h.material_number, h.plant, h.valid_from, h.valid_to,
               i.quota_item, i.vendor_number, v.vendor_name, v.country, i.procurement_type,
               i.quota, i.planned_delivery_days,
               CASE WHEN t.total <> 0 THEN CAST(i.quota AS DOUBLE) / t.total END AS quote_percent
        FROM stg_equk h
        JOIN stg_equp i USING (quota_arrangement_number)
        JOIN (SELECT quota_arrangement_number, CAST(SUM(quota) AS DOUBLE) AS total
              FROM stg_equp GROUP BY ALL) t USING (quota_arrangement_number)
        LEFT JOIN stg_lfa1 v USING (vendor_number)
        WHERE h.valid_from <= {ANCHOR} AND h.valid_to >= {ANCHOR}""",
    "transit": """
        SELECT l.lifnr AS vendor_number, l.ekorg AS purchasing_org, l.werks AS plant,
               v.vendor_name, v.country, p.plant_name, p.factory_calendar_key, l.transit_time_days
        FROM lane l LEFT JOIN stg_lfa1 v ON v.vendor_number = l.lifnr
        LEFT JOIN stg_t001w p ON p.plant = l.werks""",
    "po": """
        SELECT i.ekpo_id, h.po_number, h.vendor_number, h.purchasing_org, i.po_item, i.marc_id,
               i.material_number, i.plant, h.po_type, h.po_date, i.order_quantity
        FROM stg_ekpo i JOIN stg_ekko h USING (po_number)
        WHERE (h.deletion_flag IS NULL OR NOT list_contains(['L', 'S', 'X'], h.deletion_flag))
          AND (i.deletion_flag IS NULL OR NOT list_contains(['L', 'S', 'X'], i.deletion_flag))""",
    "po_tq": """
        SELECT po.*, t.transit_time_days, t.factory_calendar_key,
               (SELECT MAX(q.quote_percent) FROM quota q
                WHERE q.material_number = po.material_number AND q.plant = po.plant
                  AND q.vendor_number = po.vendor_number) AS quote_percent
        FROM po LEFT JOIN transit t ON t.vendor_number = po.vendor_number
            AND t.plant = po.plant AND t.purchasing_org = po.purchasing_org""",
    "tt": """
        SELECT marc_id, vendor_number, transit_time_days, quote_percent,
               (SELECT MAX(x.transit_time_days) FROM po_tq x WHERE x.marc_id = g.marc_id) AS max_tt
        FROM (SELECT marc_id, vendor_number, MAX(transit_time_days) AS transit_time_days,
                     MAX(quote_percent) AS quote_percent
              FROM po_tq GROUP BY marc_id, vendor_number) g""",
    "sched": """
        SELECT ekpo_id, po_number, po_item, delivery_date,
               MIN(goods_receipt_date) AS goods_receipt_date,
               SUM(scheduled_quantity) AS scheduled_quantity,
               SUM(goods_receipt_quantity) AS goods_receipt_quantity,
               SUM(open_quantity) AS open_quantity
        FROM stg_eket GROUP BY ALL""",
    "open_line": """
        SELECT p.ekpo_id, p.po_number, s.po_item, p.vendor_number, v.vendor_name, v.country,
               p.purchasing_org, p.po_type, p.po_date, p.marc_id, p.material_number, p.plant,
               s.delivery_date, s.scheduled_quantity, s.goods_receipt_quantity, s.open_quantity,
               m.gr_processing_days, p.transit_time_days, p.quote_percent,
               COALESCE((SELECT w.day FROM first_workday f JOIN workday w
                             ON w.n = f.n + CAST(round(COALESCE(m.gr_processing_days, 0)) AS INTEGER)
                         WHERE f.day = s.delivery_date),
                        s.delivery_date + CAST(round(COALESCE(m.gr_processing_days, 0)) AS INTEGER))
                   AS planned_availability_date
        FROM sched s JOIN po_tq p USING (ekpo_id)
        LEFT JOIN stg_marc m ON m.marc_id = p.marc_id
        LEFT JOIN stg_lfa1 v ON v.vendor_number = p.vendor_number
        WHERE s.open_quantity > 0""",
    "inbound": """
        SELECT h.delivery_number, h.delivery_type, h.created_date,
               h.planned_delivery_date AS planned_delivery_date_hdr, h.actual_goods_issue_date,
               CASE WHEN h.actual_goods_issue_date < h.created_date THEN h.actual_goods_issue_date
                    ELSE COALESCE(h.created_date, h.actual_goods_issue_date) END AS gr_date,
               i.delivery_item, i.material_number, i.plant, i.material_group, i.storage_location,
               i.reference_document, i.reference_item, i.movement_type, i.goods_receipt_date,
               i.delivery_quantity, i.unit_of_measure, u.goods_movement_status, m.marc_id,
               m.gr_processing_days
        FROM stg_lips i JOIN stg_likp h USING (delivery_number)
        LEFT JOIN stg_vbup u ON u.document_number = i.delivery_number
            AND u.document_item = i.delivery_item
        LEFT JOIN stg_marc m ON m.material_number = i.material_number AND m.plant = i.plant""",
    "asn_day": """
        SELECT b.*, e.vendor_number, v.vendor_name, v.country,
               (SELECT w.day FROM first_workday f JOIN workday w
                    ON w.n = f.n + CAST(round(COALESCE(b.gr_processing_days, 0)) AS INTEGER)
                WHERE f.day = b.gr_date) AS planned_availability_date
        FROM inbound b LEFT JOIN stg_ekko e ON e.po_number = b.reference_document
        LEFT JOIN stg_lfa1 v ON v.vendor_number = e.vendor_number
        WHERE b.goods_movement_status IS DISTINCT FROM 'C'""",
    "asn_flag": f"""
        SELECT *, CASE WHEN planned_availability_date < {ANCHOR} THEN 'overdue'
                       WHEN planned_availability_date >= {ANCHOR} THEN 'future'
                       ELSE 'pending' END AS asn_status
        FROM asn_day""",
    "asn": """
        SELECT *, (SELECT COALESCE(SUM(x.delivery_quantity), 0) FROM asn_flag x
                   WHERE x.marc_id IS NOT DISTINCT FROM a.marc_id AND x.asn_status <> 'future')
                   AS asn_total_due_qty
        FROM asn_flag a""",
    "covered": """
        SELECT l.*, COALESCE((SELECT SUM(a.delivery_quantity) FROM asn_flag a
                              WHERE a.asn_status = 'future' AND a.marc_id = l.marc_id
                                AND a.vendor_number = l.vendor_number
                                AND a.planned_availability_date <= l.planned_availability_date), 0)
                   AS cumulative_asn_qty
        FROM open_line l""",
    "late": f"""
        SELECT *, open_quantity - cumulative_asn_qty AS order_qty_due,
               CAST(open_quantity > cumulative_asn_qty
                    AND date_diff('day', delivery_date, {ANCHOR})
                        <= COALESCE(transit_time_days, 0) AS INTEGER) AS late_shipment_flag
        FROM covered""",
    "demand": """
        SELECT reservation_number AS customer_order, reservation_item AS co_item,
               reservation_type AS requirement_type, material_number || '-' || plant AS marc_id,
               material_number, plant, requirement_date,
               CAST(required_quantity - withdrawn_quantity AS DECIMAL(18,4)) AS demand_qty,
               'RESB' AS demand_source
        FROM stg_resb WHERE required_quantity > withdrawn_quantity
        UNION ALL
        SELECT sales_order_number, sales_order_item, requirement_type,
               material_number || '-' || plant, material_number, plant, requirement_date,
               open_requirement_qty, 'VBBE'
        FROM stg_vbbe""",
    "known_demand": "SELECT * FROM demand WHERE marc_id IN (SELECT marc_id FROM stg_marc)",
    "overdue": f"""
        SELECT marc_id, SUM(CASE WHEN requirement_date < {ANCHOR} THEN demand_qty ELSE 0 END)
                   AS backlog_per_pn
        FROM known_demand GROUP BY marc_id""",
    "overdue_type": f"""
        SELECT marc_id, demand_source, requirement_type,
               SUM(CASE WHEN requirement_date < {ANCHOR} THEN demand_qty ELSE 0 END)
                   AS backlog_per_pn_contype
        FROM known_demand GROUP BY ALL""",
    "near_demand": f"""
        SELECT d.marc_id, d.customer_order, d.co_item, d.demand_source, d.requirement_type,
               d.material_number, d.plant, d.requirement_date, d.demand_qty, o.backlog_per_pn,
               COALESCE(t.backlog_per_pn_contype, 0) AS backlog_per_pn_contype
        FROM known_demand d JOIN overdue o ON o.marc_id = d.marc_id
        LEFT JOIN overdue_type t ON t.marc_id = d.marc_id AND t.demand_source = d.demand_source
            AND t.requirement_type = d.requirement_type
        WHERE d.requirement_date >= {ANCHOR} AND d.requirement_date <= {END}""",
    "backlog": f"""
        SELECT * FROM near_demand
        UNION ALL BY NAME
        SELECT marc_id, backlog_per_pn, 0 AS backlog_per_pn_contype
        FROM overdue
        WHERE backlog_per_pn > 0 AND marc_id NOT IN (
            SELECT marc_id FROM known_demand WHERE requirement_date >= {ANCHOR})""",
    "consumed": """
        SELECT marc_id, MIN(material_number) AS material_number, MIN(plant) AS plant,
               requirement_date, SUM(demand_qty) AS daily_consumption
        FROM near_demand GROUP BY marc_id, requirement_date""",
    "supply": """
        SELECT 'Order Qty' AS supply_type, marc_id, material_number, plant, vendor_number,
               vendor_name, country, planned_availability_date, open_quantity AS order_qty,
               order_qty_due, cumulative_asn_qty AS fulfill_qty
        FROM late
        UNION ALL
        SELECT 'ASN', marc_id, material_number, plant, vendor_number, vendor_name, country,
               planned_availability_date, delivery_quantity, asn_total_due_qty, NULL
        FROM asn WHERE asn_status = 'future'""",
    "supply_ctx": """
        SELECT s.*, k.available_stock, k.safety_stock, k.abc_indicator, k.gr_processing_days,
               t.transit_time_days, t.quote_percent, t.max_tt, c.is_workingday,
               c.technical_day_number
        FROM supply s LEFT JOIN stock k ON k.marc_id = s.marc_id
        LEFT JOIN tt t ON t.marc_id = s.marc_id AND t.vendor_number = s.vendor_number
        LEFT JOIN calendar c ON c.plant = s.plant
            AND c.calendar_date = s.planned_availability_date
        WHERE s.planned_availability_date IS NOT NULL""",
    "supply_fill": f"""
        SELECT g.supply_type, g.marc_id, g.material_number, g.plant, g.vendor_number,
               g.vendor_name, g.country, c.calendar_date AS planned_availability_date,
               0 AS order_qty, 0 AS order_qty_due, c.is_workingday, c.technical_day_number
        FROM (SELECT DISTINCT supply_type, marc_id, material_number, plant, vendor_number,
                     vendor_name, country FROM supply
              WHERE supply_type = 'Order Qty' AND planned_availability_date IS NOT NULL) g
        JOIN calendar c ON c.plant = g.plant AND c.calendar_date BETWEEN {ANCHOR} AND {END}
        ANTI JOIN (SELECT DISTINCT marc_id, vendor_number, planned_availability_date AS d
                   FROM supply) s
            ON s.marc_id = g.marc_id AND s.vendor_number = g.vendor_number
            AND s.d = c.calendar_date""",
    "daily": f"""
        SELECT k.marc_id, k.material_number, k.plant, k.abc_indicator, k.available_stock,
               k.safety_stock, c.calendar_date, COALESCE(b.backlog_qty, 0) AS backlog_qty,
               COALESCE(u.daily_consumption, 0) AS daily_consumption,
               COALESCE(a.daily_asn_qty, 0) AS daily_asn_qty
        FROM stock k
        JOIN calendar c ON c.plant = k.plant AND c.calendar_date BETWEEN {ANCHOR} AND {END}
        LEFT JOIN (SELECT marc_id, MAX(backlog_per_pn) AS backlog_qty FROM backlog GROUP BY 1) b
            ON b.marc_id = k.marc_id
        LEFT JOIN consumed u ON u.marc_id = k.marc_id AND u.requirement_date = c.calendar_date
        LEFT JOIN (SELECT marc_id, planned_availability_date AS d,
                          SUM(delivery_quantity) AS daily_asn_qty
                   FROM asn_flag WHERE asn_status = 'future' GROUP BY 1, 2) a
            ON a.marc_id = k.marc_id AND a.d = c.calendar_date""",
    "sim": """
        SELECT *, available_stock - backlog_qty
                  + SUM(daily_asn_qty - daily_consumption) OVER (
                        PARTITION BY marc_id ORDER BY calendar_date
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  AS simulated_inventory_qty
        FROM daily""",
    "wait": """
        SELECT marc_id, MAX(max_tt) AS days FROM tt GROUP BY marc_id""",
    "watched": f"""
        SELECT s.*, COALESCE(w.days, 0) AS max_tt, {ANCHOR} + COALESCE(w.days, 0) AS window_end,
               s.simulated_inventory_qty < 0 AS red,
               s.calendar_date <= {ANCHOR} + COALESCE(w.days, 0) AS inside
        FROM sim s LEFT JOIN wait w ON w.marc_id = s.marc_id""",
    "report": """
        SELECT marc_id, material_number, plant, abc_indicator AS abc_class, available_stock,
               safety_stock, backlog_qty AS overdue_backlog_qty, max_tt, window_end AS end_of_tt_gr,
               SUM(red::INT)::BIGINT AS red_days, SUM((red AND inside)::INT)::BIGINT AS red_days_in_tt,
               MIN(IF(inside, simulated_inventory_qty, NULL)) AS min_qty_in_tt_gr,
               IF(BOOL_OR(red AND inside), 'Shortage', 'No Shortage') AS status
        FROM watched GROUP BY ALL""",
    "vendor": """
        SELECT v.vendor_number, v.vendor_name, v.country,
               COALESCE(d.done, 0) AS completed_delivery_lines,
               COALESCE(d.in_time, 0) AS on_time_lines,
               CASE WHEN d.done > 0 THEN round(CAST(d.in_time AS DOUBLE) / d.done, 3) END
                   AS otd_rate,
               COALESCE(l.n, 0) AS late_shipment_lines, COALESCE(l.qty, 0) AS late_qty_due,
               t.days AS avg_transit_time_days
        FROM stg_lfa1 v
        LEFT JOIN (SELECT e.vendor_number, COUNT(*) AS done,
                          SUM(CAST(b.gr_date <= b.planned_delivery_date_hdr AS BIGINT)) AS in_time
                   FROM inbound b JOIN stg_ekko e ON e.po_number = b.reference_document
                   WHERE b.goods_movement_status = 'C' GROUP BY 1) d
            ON d.vendor_number = v.vendor_number
        LEFT JOIN (SELECT vendor_number, COUNT(*) AS n, SUM(order_qty_due) AS qty
                   FROM late WHERE late_shipment_flag = 1 GROUP BY 1) l
            ON l.vendor_number = v.vendor_number
        LEFT JOIN (SELECT lifnr, round(AVG(transit_time_days), 1) AS days FROM lane GROUP BY 1) t
            ON t.lifnr = v.vendor_number""",
}

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def _needed(sql: str, found: set[str]) -> set[str]:
    for word in set(_WORD.findall(sql)) & RELATIONS.keys():
        if word not in found:
            found.add(word)
            _needed(RELATIONS[word], found)
    return found


def statement(select: str) -> str:
    """A select over the relations above, preceded by the ones it needs; those read twice are kept."""
    needed = _needed(select, set())
    readers = [select, *(RELATIONS[name] for name in needed)]

    def shared(name: str) -> str:
        reads = sum(len(re.findall(rf"\b{name}\b", sql)) for sql in readers)
        return "MATERIALIZED " if reads > 1 else ""

    parts = [f"{name} AS {shared(name)}({sql})" for name, sql in RELATIONS.items() if name in needed]
    return f"WITH {', '.join(parts)} {select}" if parts else select


# Output columns given as DOUBLE on both sides (quantities, shares), so that decimal scales
# need not agree.
QUANTITIES = {
    "stg_eket": "scheduled_quantity goods_receipt_quantity open_quantity",
    "stg_ekpo": "order_quantity net_price net_value",
    "stg_equk": "total_released_quantity",
    "stg_equp": "quota quota_usage_quantity planned_delivery_days",
    "stg_likp": "net_value",
    "stg_lips": "delivery_quantity net_value",
    "stg_marc": "gr_processing_days safety_stock reorder_point planned_delivery_days",
    "stg_mard": "unrestricted_stock quality_inspection_stock blocked_stock transfer_stock",
    "stg_resb": "required_quantity withdrawn_quantity",
    "stg_vbap": "order_quantity net_value",
    "stg_vbbe": "open_requirement_qty confirmed_qty",
    "stock": "gr_processing_days safety_stock reorder_point planned_delivery_days"
    " available_stock blocked_stock_s blocked_stock_q",
    "po": "order_quantity",
    "po_tq": "order_quantity",
    "sched": "scheduled_quantity goods_receipt_quantity open_quantity",
    "quota": "quota planned_delivery_days",
    "open_line": "scheduled_quantity goods_receipt_quantity open_quantity gr_processing_days",
    "late": "scheduled_quantity goods_receipt_quantity open_quantity gr_processing_days"
    " cumulative_asn_qty order_qty_due",
    "inbound": "delivery_quantity gr_processing_days",
    "asn": "delivery_quantity gr_processing_days asn_total_due_qty",
    "demand": "demand_qty",
    "known_demand": "demand_qty",
    "overdue": "backlog_per_pn",
    "overdue_type": "backlog_per_pn_contype",
    "near_demand": "demand_qty backlog_per_pn backlog_per_pn_contype",
    "backlog": "demand_qty backlog_per_pn backlog_per_pn_contype",
    "consumed": "daily_consumption",
    "supply": "order_qty order_qty_due fulfill_qty",
    "supply_ctx": "order_qty order_qty_due fulfill_qty available_stock safety_stock"
    " gr_processing_days",
    "sim": "available_stock safety_stock backlog_qty daily_consumption daily_asn_qty"
    " simulated_inventory_qty",
    "report": "available_stock safety_stock overdue_backlog_qty min_qty_in_tt_gr",
    "vendor": "late_qty_due avg_transit_time_days",
}
SHARES = {
    "quota": "quote_percent",
    "po_tq": "quote_percent",
    "tt": "quote_percent",
    "open_line": "quote_percent",
    "late": "quote_percent",
    "supply_ctx": "quote_percent",
}
BIGINTS = {"vendor": "on_time_lines completed_delivery_lines late_shipment_lines"}


def relation(name: str, rest: str = "", without: str = "") -> str:
    """``SELECT`` of a whole relation with its quantities as DOUBLE and shares to 6 places."""
    replaced = [f"CAST({c} AS DOUBLE) AS {c}" for c in QUANTITIES.get(name, "").split()]
    replaced += [f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in SHARES.get(name, "").split()]
    replaced += [f"CAST({c} AS BIGINT) AS {c}" for c in BIGINTS.get(name, "").split()]
    star = f"* EXCLUDE ({without})" if without else "*"
    if replaced:
        star += f" REPLACE ({', '.join(replaced)})"
    return statement(f"SELECT {star} FROM {name} {rest}")


def _red_zone(rest: str = "") -> str:
    """Days below zero with the material's summary, all of it from the watched days themselves."""
    return statement(
        "SELECT marc_id, calendar_date, CAST(simulated_inventory_qty AS DOUBLE) AS simulated_inventory_qty,"
        f" {ANCHOR} AS window_start, window_end, max_tt, CAST(available_stock AS DOUBLE) AS available_stock,"
        " CAST(safety_stock AS DOUBLE) AS safety_stock, CAST(backlog_qty AS DOUBLE) AS overdue_backlog_qty,"
        " n AS red_days_in_tt, IF(n > 0, 'Shortage', 'No Shortage') AS status"
        " FROM (SELECT *, SUM((red AND inside)::INT) OVER (PARTITION BY marc_id)::BIGINT AS n FROM watched)"
        f" WHERE red {rest}"
    )


def _marked(column: str) -> str:
    """Rows that the checks' faults are put into: the first number of a column ends in 3."""
    return f"coalesce(TRY_CAST(regexp_extract(CAST({column} AS VARCHAR), '([0-9]+)', 1) AS BIGINT) % 10 = 3, false)"


def _repeated(relation_name: str, column: str) -> str:
    return f"(SELECT * FROM {relation_name} UNION ALL SELECT * FROM {relation_name} WHERE {_marked(column)})"


def _counts(rows: dict[str, str]) -> str:
    """One ``(rule, n_violations)`` row per rule from a count expression or subquery."""
    return " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, CAST(({sql}) AS BIGINT) AS n_violations"
        for rule, sql in rows.items()
    )


def _duplicates(relation_name: str, columns: str) -> str:
    return (
        f"SELECT COUNT(*) FROM (SELECT {columns} FROM {relation_name}"
        f" WHERE ({columns.split(',')[0]}) IS NOT NULL GROUP BY {columns} HAVING COUNT(*) > 1)"
    )


def _extra(relation_name: str, columns: str) -> str:
    return (
        f"SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {columns}"
        f" FROM {relation_name})) FROM {relation_name}"
    )


def _missing(child: str, columns: str, parent: str, parent_columns: str) -> str:
    pairs = zip(columns.split(","), parent_columns.split(","), strict=True)
    same = " AND ".join(f"p.{b.strip()} = c.{a.strip()}" for a, b in pairs)
    return f"SELECT COUNT(*) FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE {same})"


def _measure(rule: str, measured: str, required: str, test: str, source: str) -> str:
    return (
        f"SELECT '{rule}' AS rule, CAST(measured AS DOUBLE) AS measured,"
        f" CAST(required AS DOUBLE) AS required, measured {test} required AS passed"
        f" FROM (SELECT {measured} AS measured, {required} AS required {source})"
    )


_FOREIGN_KEYS = {
    "VBAP(vbeln) in VBAK(vbeln)": (
        "stg_vbap", "sales_order_number", "stg_vbak", "sales_order_id"),
    "LIPS(vgbel) in EKKO(ebeln)": ("stg_lips", "reference_document", "stg_ekko", "po_number"),
    "EKPO(ebeln) in EKKO(ebeln)": ("stg_ekpo", "po_number", "stg_ekko", "po_number"),
    "VBAP(matnr) in MARA(matnr)": ("stg_vbap", "material_number", "mara", "matnr"),
    "LIPS(vbeln) in LIKP(vbeln)": (
        "stg_lips", "delivery_number", "stg_likp", "delivery_number"),
    "VBBE(vbeln) in VBAK(vbeln)": (
        "stg_vbbe", "sales_order_number", "stg_vbak", "sales_order_id"),
    "EQUP(qunum) in EQUK(qunum)": (
        "stg_equp", "quota_arrangement_number", "stg_equk", "quota_arrangement_number"),
}
_COMPOSITE_KEYS = {
    "EKPO(matnr,werks) in MARC(matnr,werks)": (
        "stg_ekpo", "material_number,plant", "stg_marc", "material_number,plant"),
    "LIPS(vbeln,posnr) in VBUP(vbeln,posnr)": (
        "stg_lips", "delivery_number,delivery_item", "stg_vbup", "document_number,document_item"),
    "EKET(ebeln,ebelp) in EKPO(ebeln,ebelp)": (
        "stg_eket", "po_number,po_item", "stg_ekpo", "po_number,po_item"),
    "VBBE(matnr,werks) in MARC(matnr,werks)": (
        "stg_vbbe", "material_number,plant", "stg_marc", "material_number,plant"),
}
_PRIMARY_KEYS = {
    "VBAK(vbeln)": ("stg_vbak", "sales_order_id"),
    "VBAP(vbeln,posnr)": ("stg_vbap", "sales_order_number, sales_order_item"),
    "LIKP(vbeln)": ("stg_likp", "delivery_number"),
    "LIPS(vbeln,posnr)": ("stg_lips", "delivery_number, delivery_item"),
    "VBUP(vbeln,posnr)": ("stg_vbup", "document_number, document_item"),
    "EKKO(ebeln)": ("stg_ekko", "po_number"),
    "EKPO(ebeln,ebelp)": ("stg_ekpo", "po_number, po_item"),
    "EKET(ebeln,ebelp,etenr)": ("stg_eket", "po_number, po_item, schedule_line_number"),
    "MARA(matnr)": ("mara", "matnr"),
    "MARC(matnr,werks)": ("stg_marc", "material_number, plant"),
    "MARD(matnr,werks,lgort)": ("stg_mard", "material_number, plant, storage_location"),
    "T001W(werks)": ("stg_t001w", "plant"),
    "KNA1(kunnr)": ("kna1", "kunnr"),
    "LFA1(lifnr)": ("stg_lfa1", "vendor_number"),
    "EQUK(qunum)": ("stg_equk", "quota_arrangement_number"),
    "EQUP(qunum,qupos)": ("stg_equp", "quota_arrangement_number, quota_item"),
}
RELATIONS["mara"] = """
    SELECT lpad(CAST(p_partkey AS VARCHAR), 18, '0') AS matnr, '19980101' AS ersda FROM part"""
RELATIONS["kna1"] = "SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS kunnr FROM customer"


def _nulls(source: str, columns: str) -> str:
    """NULLs in a key whose first field is blanked in the marked rows."""
    first, *others = (c.strip() for c in columns.split(","))
    each = [f"COUNT(CASE WHEN {first} IS NULL OR {_marked(first)} THEN 1 END)"]
    each += [f"COUNT(*) - COUNT({c})" for c in others]
    return f"SELECT {' + '.join(each)} FROM {source}"


_ROW_COUNTS = {
    t: f"SELECT COUNT(*) FROM stg_{t.lower()}"
    for t in "EKET EKKO EKPO EQUK EQUP LFA1 LIKP LIPS MARC MARD RESB T001W TFACT VBAK VBAP VBBE"
    " VBUP".split()
} | {"KNA1": "SELECT COUNT(*) FROM kna1", "MARA": "SELECT COUNT(*) FROM mara"}
_LEAST = {
    "VBAK": 5000, "VBAP": 20000, "LIKP": 4000, "EKKO": 1500, "EKPO": 4000, "MARA": 500,
    "KNA1": 100, "LFA1": 50,
}

DOUBLES = "CAST({0} AS DOUBLE) AS {0}"

ORACLES = {
    # sources
    "seed_transit_time": relation("lane"),
    "lane_matrix": relation("lane"),
    "load_audit": statement(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, ({q}) AS n_rows" for t, q in _ROW_COUNTS.items()
        )
        + ") UNION ALL SELECT 'total', CAST("
        + " + ".join(f"({q})" for q in _ROW_COUNTS.values())
        + " AS BIGINT)"
    ),
    "extract_latest": statement(
        "SELECT 'LFA1' AS table_name, '20000103' AS stamp, COUNT(*) AS n_rows FROM stg_lfa1"
        " UNION ALL SELECT 'RESB', '20000103', COUNT(*) FROM stg_resb"
    ),
    "bronze_read": statement(
        "SELECT reservation_number AS rsnum, reservation_item AS rspos, reservation_type AS rsart,"
        " material_number AS matnr, plant AS werks, CAST(required_quantity AS VARCHAR) AS bdmng,"
        " CAST(withdrawn_quantity AS VARCHAR) AS enmng, unit_of_measure AS meins,"
        " strftime(requirement_date, '%Y%m%d') AS bddat, "
        + ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in "mandt lgort aufnr vbeln kzear".split())
        + " FROM stg_resb"
    ),
    "bronze_write": statement(
        "SELECT vendor_number AS lifnr, country AS land1, vendor_name AS name1, city AS ort01,"
        " region AS regio, strftime(created_date, '%Y%m%d') AS erdat,"
        " payment_block_flag AS sperr, "
        + ", ".join(
            f"CAST(NULL AS VARCHAR) AS {c}" for c in "mandt pstlz ktokk stcd1 ernam xcpdk".split()
        )
        + " FROM stg_lfa1"
    ),
    "layer_tables": statement(
        "SELECT 'bronze' AS layer, 'MARC' AS table_name, COUNT(*) AS n_rows FROM stg_marc"
        " UNION ALL SELECT 'intermediate', 'int_pn_infor', COUNT(*) FROM stock"
        " UNION ALL SELECT 'analytics', 'mart_consumption', COUNT(*) FROM consumed"
    ),
    # staging
    **{
        f"stg_{t}": relation(f"stg_{t}")
        for t in "eket ekko ekpo equk equp lfa1 likp lips marc mard resb t001w tfact vbak vbap vbbe"
        " vbup".split()
    },
    # material context and calendar
    "material_base": relation("stg_marc"),
    "material_stock_context": relation("stock"),
    "factory_calendar": relation("calendar"),
    "working_calendar": statement(
        "SELECT plant, factory_calendar_key, calendar_date, w.n AS working_day_index"
        " FROM calendar JOIN workday w ON w.day = calendar_date"
    ),
    "add_working_days": statement(
        "SELECT reservation_number, reservation_item, material_number, r.plant, requirement_date,"
        " CAST(gr_processing_days AS DOUBLE) AS gr_processing_days,"
        " (SELECT w.day FROM first_workday f JOIN workday w ON w.n = f.n"
        "  + CAST(round(COALESCE(m.gr_processing_days, 0)) AS INTEGER)"
        "  WHERE f.day = r.requirement_date) AS available_date"
        " FROM stg_resb r LEFT JOIN stg_marc m USING (material_number, plant)"
    ),
    # quota and transit
    "quota_header_active": relation(
        "stg_equk",
        f"WHERE valid_from <= {ANCHOR} AND valid_to >= {ANCHOR}",
        without="created_date",
    ),
    "quota_item": relation("stg_equp"),
    "quota_share": relation("quota"),
    "transit_time": relation("transit"),
    "transit_quota": relation("tt"),
    # purchasing
    "po_active": relation("po"),
    "po_transit_quota": relation("po_tq"),
    "schedule_by_date": relation("sched"),
    "scheduling_agreement": statement(
        "SELECT p.po_number, vendor_number, purchasing_org, po_type, po_date, marc_id,"
        " material_number, plant, ekpo_id, s.po_item, delivery_date, goods_receipt_date, "
        + ", ".join(DOUBLES.format(c) for c in QUANTITIES["sched"].split())
        + " FROM sched s JOIN po p USING (ekpo_id)"
    ),
    "open_schedule": relation("open_line"),
    "late_shipment": relation("late"),
    # deliveries
    "inbound_deliveries": relation("inbound"),
    "asn_status": relation(
        "asn",
        without="actual_goods_issue_date, material_group, storage_location, reference_document,"
        " reference_item, movement_type, goods_receipt_date, unit_of_measure",
    ),
    # demand
    "demand_union": relation("demand"),
    "demand_valid": relation("known_demand"),
    "overdue_by_material": relation("overdue"),
    "overdue_by_type": relation("overdue_type"),
    "future_demand": relation("near_demand"),
    "backlog": relation("backlog"),
    # supply
    "supply": relation("supply"),
    "supply_context": relation("supply_ctx"),
    "supply_gap_fill": statement(
        "SELECT * REPLACE (CAST(order_qty AS DOUBLE) AS order_qty, CAST(order_qty_due AS DOUBLE)"
        " AS order_qty_due), "
        + ", ".join(
            f"CAST(NULL AS {t}) AS {c}"
            for c, t in {
                "fulfill_qty": "DOUBLE",
                "available_stock": "DOUBLE",
                "safety_stock": "DOUBLE",
                "abc_indicator": "VARCHAR",
                "gr_processing_days": "DOUBLE",
                "transit_time_days": "INTEGER",
                "quote_percent": "DOUBLE",
                "max_tt": "INTEGER",
            }.items()
        )
        + " FROM supply_fill"
    ),
    # marts
    "detail_supply": statement(
        "SELECT * REPLACE ("
        + ", ".join(
            [f"CAST({c} AS DOUBLE) AS {c}" for c in QUANTITIES["supply_ctx"].split()]
            + ["round(CAST(quote_percent AS DOUBLE), 6) AS quote_percent"]
        )
        + ") FROM (SELECT * FROM supply_ctx UNION ALL BY NAME SELECT * FROM supply_fill)"
    ),
    "consumption": relation("consumed"),
    "inventory_simulation": relation("sim"),
    "shortage_report": relation("report"),
    "vendor_performance": relation("vendor"),
    # serving
    "shortage_ranked": relation("report"),
    "simulation_for_material": relation(
        "sim",
        "WHERE marc_id = '000000000000000001-1001'",
    ),
    "vendors_ranked": relation("vendor"),
    "consumption_trend": statement(
        "SELECT requirement_date, plant, CAST(SUM(daily_consumption) AS DOUBLE)"
        " AS total_consumption FROM consumed GROUP BY ALL"
    ),
    "top_demand_materials": statement(
        "SELECT marc_id, material_number, plant, CAST(total AS DOUBLE) AS total_demand FROM"
        " (SELECT marc_id, MAX(material_number) AS material_number, MAX(plant) AS plant,"
        "  SUM(daily_consumption) AS total FROM consumed GROUP BY marc_id)"
        " ORDER BY total DESC, marc_id LIMIT 10"
    ),
    "backlog_by_plant": statement(
        "SELECT plant, CAST(SUM(overdue_backlog_qty) AS DOUBLE) AS overdue_backlog_qty,"
        " COUNT(CASE WHEN overdue_backlog_qty > 0 THEN 1 END) AS materials_with_backlog"
        " FROM report GROUP BY plant"
    ),
    "shortage_filtered": relation(
        "report",
        "WHERE plant = '1001' AND abc_class = 'C' AND status = 'Shortage'"
        " AND regexp_matches(material_number, '[1-5]$')",
    ),
    "filter_options": statement(
        "SELECT DISTINCT 'plant' AS filter, plant AS option FROM report WHERE plant IS NOT NULL"
        " UNION ALL SELECT DISTINCT 'abc_class', abc_class FROM report WHERE abc_class IS NOT NULL"
    ),
    "overview_kpis": statement(
        "SELECT COUNT(*) AS materials, COUNT(CASE WHEN status = 'Shortage' THEN 1 END)"
        " AS shortage_count,"
        " round(100.0 * COUNT(CASE WHEN status = 'Shortage' THEN 1 END) / COUNT(*), 1)"
        " AS shortage_pct,"
        " CAST(SUM(overdue_backlog_qty) AS DOUBLE) AS overdue_total,"
        " MAX(red_days) AS max_red_days FROM report"
    ),
    "red_zone": _red_zone(f"AND marc_id = '{SHOWN_MATERIAL}'"),
    "red_zones": _red_zone(),
    "vendor_kpis": statement(
        "SELECT COUNT(*) AS vendors, round(AVG(otd_rate), 6) AS avg_otd, MIN(otd_rate)"
        " AS worst_otd,"
        " (SELECT vendor_name FROM vendor WHERE otd_rate IS NOT NULL"
        "  ORDER BY otd_rate, vendor_number LIMIT 1) AS worst_vendor,"
        " CAST(SUM(late_qty_due) AS DOUBLE) AS late_qty_total FROM vendor"
    ),
    "vendors_bottom10": relation(
        "vendor", "WHERE otd_rate IS NOT NULL ORDER BY otd_rate, vendor_number LIMIT 10"
    ),
    "vendor_band": statement(
        "SELECT vendor_number, vendor_name, otd_rate, CASE WHEN otd_rate >= 0.85 THEN 'good'"
        " WHEN otd_rate >= 0.6 THEN 'warn' ELSE 'bad' END AS band"
        " FROM vendor WHERE otd_rate IS NOT NULL"
    ),
    "demand_kpis": statement(
        "SELECT (SELECT CAST(SUM(daily_consumption) AS DOUBLE) FROM consumed) AS total_demand,"
        " CAST(SUM(overdue_backlog_qty) AS DOUBLE) AS total_backlog,"
        " COUNT(CASE WHEN overdue_backlog_qty > 0 THEN 1 END) AS materials_with_backlog"
        " FROM report"
    ),
    "weekly_demand": statement(
        "SELECT plant, CAST(w AS DATE) AS week_ending, CAST((SELECT COALESCE(SUM("
        "c.daily_consumption), 0) FROM consumed c WHERE c.plant = s.plant"
        " AND c.requirement_date BETWEEN CAST(w AS DATE) - 6 AND CAST(w AS DATE)) AS DOUBLE)"
        " AS total_consumption"
        " FROM (SELECT plant, MIN(requirement_date) AS a, MAX(requirement_date) AS b"
        "       FROM consumed GROUP BY plant) s,"
        " generate_series(a + CAST(7 - isodow(a) AS INTEGER),"
        " b + CAST(7 - isodow(b) AS INTEGER), INTERVAL 7 DAY) AS g(w)"
    ),
    # model tests
    "dq_unique": statement(
        _counts(
            {
                f"unique {table}.{c}": _duplicates(_repeated(source, c), c)
                for table, source, c in [
                    ("stg_marc", "stg_marc", "marc_id"),
                    ("stg_ekko", "stg_ekko", "po_number"),
                    ("stg_ekpo", "stg_ekpo", "ekpo_id"),
                    ("stg_likp", "stg_likp", "delivery_number"),
                    ("int_pn_infor", "stock", "marc_id"),
                    ("mart_shortage_report", "report", "marc_id"),
                    ("mart_vendor_performance", "vendor", "vendor_number"),
                ]
            }
        )
    ),
    "dq_not_null": statement(
        _counts(
            {
                f"not_null {table}.{c}": f"SELECT COUNT(*) FROM {source}"
                f" WHERE {c} IS NULL OR {_marked(c)}"
                for table, source, c in [
                    ("stg_marc", "stg_marc", "marc_id"),
                    ("stg_ekko", "stg_ekko", "po_number"),
                    ("stg_ekpo", "stg_ekpo", "ekpo_id"),
                    ("stg_ekpo", "stg_ekpo", "marc_id"),
                    ("stg_likp", "stg_likp", "delivery_number"),
                    ("int_pn_infor", "stock", "marc_id"),
                    ("int_pn_infor", "stock", "available_stock"),
                    ("mart_shortage_report", "report", "marc_id"),
                    ("mart_vendor_performance", "vendor", "vendor_number"),
                ]
            }
        )
    ),
    "dq_accepted_values": statement(
        _counts(
            {
                f"accepted_values {table}.{c}": "SELECT COUNT(DISTINCT v) FROM (SELECT CASE"
                f" WHEN {_marked(by)} THEN 'Z' || CAST(CAST(regexp_extract({by}, '([0-9]+)', 1)"
                f" AS BIGINT) % 3 AS VARCHAR) ELSE {c} END AS v FROM {source})"
                f" WHERE v NOT IN ({values})"
                for table, source, c, by, values in [
                    ("stg_marc", "stg_marc", "procurement_type", "marc_id", "''F'', ''E'', ''X''"),
                    ("stg_vbup", "stg_vbup", "goods_movement_status", "document_item", "''A'', ''B'', ''C''"),
                    (
                        "int_inbound_deliveries_asn",
                        "asn_flag",
                        "asn_status",
                        "marc_id",
                        "''future'', ''overdue'', ''pending''",
                    ),
                    (
                        "mart_shortage_report",
                        "report",
                        "status",
                        "marc_id",
                        "''Shortage'', ''No Shortage''",
                    ),
                ]
            }
        ).replace("''", "'")
    ),
    "dq_unique_combo": statement(
        _counts(
            {
                f"unique {table}({columns})": _duplicates(
                    _repeated(source, columns.split(",")[0]), columns
                )
                for table, source, columns in [
                    ("int_factory_calendar", "calendar", "plant,calendar_date"),
                    (
                        "int_working_calendar",
                        "(SELECT * FROM calendar WHERE is_workingday = 1)",
                        "plant,calendar_date",
                    ),
                    ("int_tt_quota", "tt", "marc_id,vendor_number"),
                    ("mart_inventory_simulation", "sim", "marc_id,calendar_date"),
                    ("mart_consumption", "consumed", "marc_id,requirement_date"),
                ]
            }
        )
    ),
    "dq_rate_range": statement(
        _counts(
            {
                "otd_rate between 0 and 1": "SELECT COUNT(*) FROM vendor"
                f" WHERE {_marked('vendor_number')} OR NOT (otd_rate BETWEEN 0 AND 1)"
            }
        )
    ),
    "dq_null_projection": statement(
        _counts(
            {
                "projected quantity not null": "SELECT COUNT(*) FROM sim"
                f" WHERE {_marked('marc_id')} OR simulated_inventory_qty IS NULL"
            }
        )
    ),
    "dq_negative_transit": statement(
        _counts(
            {
                "max_tt not negative": "SELECT COUNT(*) FROM tt"
                f" WHERE {_marked('marc_id')} OR sign(max_tt) = -1"
            }
        )
    ),
    "dq_negative_red_days": statement(
        _counts(
            {
                "red_days not negative": "SELECT COUNT(*) FROM report"
                f" WHERE {_marked('marc_id')} OR sign(red_days) = -1"
            }
        )
    ),
    # extract checks
    "fk_orphans": statement(_counts({r: _missing(*k) for r, k in _FOREIGN_KEYS.items()})),
    "fk_orphans_composite": statement(
        _counts({r: _missing(*k) for r, k in _COMPOSITE_KEYS.items()})
    ),
    "pk_nulls": statement(_counts({r: _nulls(*k) for r, k in _PRIMARY_KEYS.items()})),
    "pk_duplicates": statement(
        _counts(
            {
                r: _extra(*k)
                for r, k in _PRIMARY_KEYS.items()
                if r not in ("KNA1(kunnr)", "LFA1(lifnr)")
            }
        )
    ),
    # the marked rows have texts that are no days, all others days; a blank one is not checked
    "date_format": statement(
        _counts(
            {
                r: f"SELECT COUNT(*) FROM {t} WHERE {_marked(by)}"
                for r, t, by in [
                    ("VBAK.erdat", "stg_vbak", "sales_order_id"),
                    ("LIKP.erdat", "stg_likp", "delivery_number"),
                    ("LIKP.wadat", "stg_likp", "delivery_number"),
                    ("LIKP.wadat_ist", "stg_likp", "delivery_number"),
                    ("EKKO.bedat", "stg_ekko", "po_number"),
                    ("EKET.eindt", "stg_eket", "po_number"),
                    ("VBBE.mbdat", "stg_vbbe", "sales_order_number"),
                    ("RESB.bddat", "stg_resb", "reservation_number"),
                    ("MARA.ersda", "mara", "matnr"),
                ]
            }
        )
    ),
    "id_length": statement(
        _counts(
            {
                f"{r} has {n} characters": f"SELECT COUNT(*) FROM {t} WHERE length({c}) <> {n}"
                for r, t, c, n in [
                    ("MARA.matnr", "mara", "matnr", 18),
                    ("VBAK.vbeln", "stg_vbak", "sales_order_id", 10),
                    ("LIKP.vbeln", "stg_likp", "delivery_number", 10),
                    ("KNA1.kunnr", "kna1", "kunnr", 10),
                    ("LFA1.lifnr", "stg_lfa1", "vendor_number", 10),
                ]
            }
        )
    ),
    "constant_value": statement(
        _counts(
            {
                r: f"SELECT COUNT(*) FROM {t} WHERE {_marked(by)}"
                for r, t, by in [
                    ("VBAK.mandt is 100", "stg_vbak", "sales_order_id"),
                    ("EKKO.mandt is 100", "stg_ekko", "po_number"),
                    ("MARA.mandt is 100", "mara", "matnr"),
                    ("LIKP.lfart is EL", "stg_likp", "delivery_number"),
                ]
            }
        )
    ),
    # the marked lines have received 1000, more than any line orders
    "over_receipt": statement(
        _counts(
            {
                "received <= ordered": "SELECT COUNT(*) FROM stg_eket"
                f" WHERE {_marked('po_number')}"
                " OR goods_receipt_quantity > scheduled_quantity + 0.01"
            }
        )
    ),
    "early_receipt": statement(
        _counts(
            {
                "nothing received before it is due": "SELECT COUNT(*) FROM stg_eket"
                f" WHERE delivery_date > {ANCHOR}"
                f" AND ({_marked('po_number')} OR goods_receipt_quantity > 0)"
            }
        )
    ),
    "value_tolerance": statement(
        _counts(
            {
                "value = quantity x price": "SELECT COUNT(*) FROM stg_ekpo"
                " WHERE abs(net_value - order_quantity * net_price)"
                " > abs(order_quantity * net_price) * 0.01 + 0.05"
            }
        )
    ),
    "receipt_in_future": statement(
        _counts(
            {
                "confirmed receipts not after the anchor": "SELECT COUNT(*) FROM stg_likp"
                f" WHERE actual_goods_issue_date > {ANCHOR}"
            }
        )
    ),
    "asn_status_conflict": statement(
        _counts(
            {
                "deliveries underway are not received": "SELECT COUNT(*) FROM stg_vbup"
                f" WHERE ({_marked('document_number')} OR goods_movement_status = 'C')"
                " AND document_number IN (SELECT"
                " delivery_number FROM stg_likp WHERE actual_goods_issue_date IS NULL)"
            }
        )
    ),
    "open_qty_positive": statement(
        _counts(
            {
                "open quantity positive": "SELECT COUNT(*) FROM stg_vbbe"
                " WHERE open_requirement_qty <= 0 OR open_requirement_qty IS NULL"
                f" OR {_marked('sales_order_number')} OR {_marked('sales_order_item')}"
            }
        )
    ),
    "future_demand_share": statement(
        _measure(
            "demand lines on or after the anchor",
            f"COUNT(CASE WHEN requirement_date >= {ANCHOR} THEN 1 END)",
            "COUNT(requirement_date) * 0.5",
            ">",
            "FROM stg_vbbe",
        )
    ),
    "future_supply_count": statement(
        _measure(
            "schedule lines on or after the anchor",
            f"COUNT(CASE WHEN delivery_date >= {ANCHOR} THEN 1 END)",
            "100",
            ">",
            "FROM stg_eket",
        )
    ),
    "pareto_share": statement(
        "SELECT 'share of the top fifth of materials' AS rule, share AS measured,"
        " CAST(0.5 AS DOUBLE) AS required, share >= 0.5 AS passed FROM"
        " (SELECT round(CAST(SUM(CASE WHEN place <= greatest(1, n // 5) THEN qty END) AS DOUBLE)"
        "         / CAST(SUM(qty) AS DOUBLE), 6) AS share"
        "  FROM (SELECT qty, row_number() OVER (ORDER BY qty DESC) AS place, COUNT(*) OVER () AS n"
        "        FROM (SELECT material_number, SUM(order_quantity) AS qty FROM stg_vbap"
        "              GROUP BY 1)))"
    ),
    "active_quota_share": statement(
        _measure(
            "quota windows containing the anchor",
            f"COUNT(CASE WHEN {ANCHOR} BETWEEN valid_from AND valid_to THEN 1 END)",
            "COUNT(*) * 0.8",
            ">=",
            "FROM stg_equk",
        )
    ),
    "min_volume": statement(
        " UNION ALL ".join(
            _measure(f"{t} rows", f"({_ROW_COUNTS[t]})", str(n), ">=", "")
            for t, n in _LEAST.items()
        )
    ),
}
