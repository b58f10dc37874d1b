from tablelens.plans.reports import ads_report, posts_report, tweets_report

__all__ = ["ads_report", "posts_report", "tweets_report"]
