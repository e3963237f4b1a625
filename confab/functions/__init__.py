"""confab.functions"""
