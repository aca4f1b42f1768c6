"""SQL of the URL rules and their aliases; relative links with ``.`` or ``..`` steps are not resolved here."""

from __future__ import annotations

from collections.abc import Sequence

from packetgrain.llm.url_filter import TRACKING, Rule


def _rest(url: str) -> str:
    return f"coalesce(CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) END, '')"


def _host(url: str) -> str:
    return f"translate(regexp_extract({_rest(url)}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(url: str) -> str:
    return f"regexp_extract({_rest(url)}, '^[^/?#]*([^?#]*)', 1)"


def _attribute(name: str) -> str:
    pattern = rf"""(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    return "(" + " || ".join(f"regexp_extract(tag, '{pattern}', {i})" for i in (1, 2, 3)) + ")"


def _decided(rules: Sequence[Rule], what: int) -> str:
    cases = []
    for rule in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]))):
        value = rule[0] + rule[1] if what == 0 else rule[2]
        cases.append(f"WHEN (host = '{rule[0]}' OR ends_with(host, '.{rule[0]}')) AND starts_with(path, '{rule[1]}') THEN '{value}'")
    return f"CASE {' '.join(cases)} END"


def sql(rules: Sequence[Rule]) -> str:
    site = f"regexp_extract(url, '^(.*?)://', 1) || '://' || regexp_extract({_rest('url')}, '^([^/?#]*)', 1)"
    folder = f"coalesce(nullif(regexp_replace({_path('url')}, '[^/]*$', ''), ''), '/')"
    return rf"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(
    regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'),
    '(?i)<(?:link|meta)[^>]*>')) AS tag
  FROM pages WHERE instr(url, '://') > 0),
said AS (
  SELECT url, replace(trim(CASE
    WHEN regexp_matches(tag, '(?i)^<link') AND list_contains(regexp_split_to_array(lower(trim({_attribute('rel')})), '\s+'), 'canonical')
      THEN {_attribute('href')}
    WHEN regexp_matches(tag, '(?i)^<meta') AND lower(trim({_attribute('http-equiv')})) = 'refresh'
      THEN regexp_extract({_attribute('content')}, '(?is)^\s*[\d.]*\s*[;,]\s*(?:url\s*=\s*)?[''"]?([^''"]*)', 1) END),
    '&amp;', '&') AS link FROM tags),
links AS (
  SELECT url AS source, CASE
    WHEN regexp_matches(link, '(?i)^https?://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(url, '^(.*?)://', 1) || ':' || link
    WHEN starts_with(link, '/') THEN {site} || link
    WHEN starts_with(link, '?') THEN {site} || {_path('url')} || link
    WHEN link = '' OR starts_with(link, '#') OR regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    ELSE {site} || {folder} || link END AS target FROM said),
found AS (SELECT source, target FROM links WHERE target IS NOT NULL),
urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT source FROM found UNION ALL SELECT target FROM found)),
parts AS (
  SELECT url, {_host('url')} AS host, {_path('url')} AS path,
    list_filter(string_split(regexp_extract({_rest('url')}, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}')) AS query FROM urls),
known AS (
  SELECT url, host, path, {_decided(rules, 0)} AS rule, {_decided(rules, 1)} AS own,
    CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.(.*\..*)$', '\2')
      || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '')
      || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS node FROM parts),
pairs AS (
  SELECT DISTINCT a.node AS u, b.node AS v FROM found JOIN known a ON a.url = source JOIN known b ON b.url = target
  WHERE a.node IS NOT NULL AND b.node IS NOT NULL AND a.node <> b.node),
edges AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
reach AS (SELECT u, v FROM edges UNION SELECT reach.u, edges.v FROM reach JOIN edges ON edges.u = reach.v),
near AS (SELECT DISTINCT node, node AS other FROM known WHERE node IS NOT NULL UNION SELECT u, v FROM reach),
votes AS (SELECT near.node, min(known.own) AS said FROM near JOIN known ON known.node = near.other GROUP BY near.node)
SELECT page_id, host, path, rule, coalesce(own, said, 'allow') AS verdict,
  CASE WHEN own IS NOT NULL THEN 'rule' WHEN said IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM pages JOIN known ON known.url IS NOT DISTINCT FROM pages.url LEFT JOIN votes ON votes.node = known.node
"""
