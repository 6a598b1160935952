"""Explicit schemas of what is read from files; nothing is inferred in a pipeline."""

from __future__ import annotations

#: The shape of a company document and of its parts.
METADATA = "struct<filing_date:string,filing_url:string,accession_number:string,form_type:string,company_ticker:string,cik:string,primary_document:string>"
REPORT = f"struct<paragraphs:array<string>,metadata:{METADATA}>"
SERIES = "struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>"
ARTICLE = "struct<title:string,publish_date:string,url:string,text:string,score:int,scoring_method:string>"
COMPANY_DOCUMENT = f"company_name string, ticker string, date_range struct<start:string,end:string>, stock_data {SERIES}, latest_10k {REPORT}, latest_10q {REPORT}, eight_k_reports array<{REPORT}>, hacker_news_articles array<{ARTICLE}>"
PREDICTION = "chain_of_thought string, output struct<next_day_direction:int,next_day_closing_price:double,forecast:struct<up:double,down:double,unchanged:double>>"
PAIR = "input string, output1 string, output2 string, timeseries array<array<float>>"
BARS = "date date, ticker string, open double, high double, low double, close double, volume bigint"
NEWS = "Date string, Title string, Text string"
STORY = "title string, url string, points bigint, num_comments bigint, created_at string"
REGISTRY = "map<string,struct<cik_str:bigint,ticker:string,title:string>>"
FILING_INDEX = "struct<filings:struct<recent:struct<accessionNumber:array<string>,form:array<string>,primaryDocument:array<string>,filingDate:array<string>>,files:array<struct<name:string,filingTo:string>>>>"
